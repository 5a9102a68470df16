"""Packets to flows: aggregation, orientation, byte direction, candidates and evidence slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postern import dims
from postern.functions.scores import count_if

FLOW = ["capture_id", "stream"]
FRAMES_PER_BLOCK = 1_000_000
SLICE_BLOCK = 65_536


def _mail(port: Column) -> Column:
    return port.isin(*dims.MAIL_PORTS)


def index_flows(packets: DataFrame) -> DataFrame:
    """One oriented row per stream.

    Packets are first combined per direction (map-side, so a stream with most of the packets arrives
    as a few rows), and the few direction rows of a stream then decide its client and server.
    """
    c = F.col
    sides = packets.groupBy(*FLOW, "src_ip", "src_port", "dst_ip", "dst_port").agg(
        F.count(F.lit(1)).alias("packets"),
        F.min("frame").alias("first_frame"),
        F.max("frame").alias("last_frame"),
        F.min_by("ts", "frame").alias("start_time"),
        F.max("ts").alias("end_time"),
        F.bool_or("syn").alias("saw_syn"),
        F.bool_or("fin").alias("saw_fin"),
        F.bool_or("rst").alias("saw_rst"),
        F.min(F.when(c("syn"), c("frame"))).alias("syn_frame"),
        F.sum(F.col("tcp_len").cast("bigint")).alias("bytes"),
    )
    ends = F.struct("src_ip", "src_port", "dst_ip", "dst_port")
    w = Window.partitionBy(*FLOW)
    syn = F.min_by(ends, F.col("syn_frame")).over(w)
    opening = F.min_by(ends, F.col("first_frame")).over(w)
    rows = sides.withColumn("_syn", syn).withColumn("_open", opening)
    o = c("_open")
    src_client = (
        F.when(_mail(o["dst_port"]) & ~_mail(o["src_port"]), F.lit(True))
        .when(_mail(o["src_port"]) & ~_mail(o["dst_port"]), F.lit(False))
        .otherwise(o["src_port"] >= o["dst_port"])
    )
    forward = F.struct(o["src_ip"].alias("src_ip"), o["src_port"].alias("src_port"), o["dst_ip"].alias("dst_ip"), o["dst_port"].alias("dst_port"))
    backward = F.struct(o["dst_ip"].alias("src_ip"), o["dst_port"].alias("src_port"), o["src_ip"].alias("dst_ip"), o["src_port"].alias("dst_port"))
    chosen = F.coalesce("_syn", F.when(src_client, forward).otherwise(backward))
    rows = rows.withColumn("_ends", chosen)
    from_client = (c("src_ip") == c("_ends.src_ip")) & (c("src_port") == c("_ends.src_port"))
    out = rows.groupBy(*FLOW, "_ends").agg(
        F.sum("packets").alias("packets"),
        F.min("first_frame").alias("first_frame"),
        F.max("last_frame").alias("last_frame"),
        F.min_by("start_time", "first_frame").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.bool_or("saw_syn").alias("saw_syn"),
        F.bool_or("saw_fin").alias("saw_fin"),
        F.bool_or("saw_rst").alias("saw_rst"),
        F.coalesce(F.sum(F.when(from_client, c("bytes"))), F.lit(0)).alias("bytes_c2s"),
        F.coalesce(F.sum(F.when(~from_client, c("bytes"))), F.lit(0)).alias("bytes_s2c"),
    )
    return (
        out.withColumn("client_ip", c("_ends.src_ip"))
        .withColumn("client_port", c("_ends.src_port"))
        .withColumn("server_ip", c("_ends.dst_ip"))
        .withColumn("server_port", c("_ends.dst_port"))
        .withColumn("mid_session", ~c("saw_syn"))
        .drop("_ends")
    )


def candidates(flows: DataFrame) -> DataFrame:
    """Add the port's protocol hint; a known mail port makes a flow a candidate."""
    dim = dims.ports(flows.sparkSession).withColumnRenamed("port", "server_port")
    return flows.join(F.broadcast(dim), "server_port", "left").withColumn("is_candidate", F.col("port_protocol").isNotNull())


def signature(head: Column) -> Column:
    """Mail protocol of a server greeting (text or bytes), NULL when it is none."""
    text = head.cast("string")
    out = None
    for prefix, protocol in dims.GREETING_PREFIXES:
        cond = text.startswith(prefix)
        out = F.when(cond, F.lit(protocol)) if out is None else out.when(cond, F.lit(protocol))
    return out


def openings(segments: DataFrame, keys: list[str], payload: str, order: str) -> DataFrame:
    """First payload of each stream: a partial min_by, never a gathered stream."""
    return segments.groupBy(*keys).agg(F.min_by(payload, order).alias("opening"))


def probe(flows: DataFrame, segments: DataFrame) -> DataFrame:
    """Mail on unregistered ports: non-candidates with server bytes whose opening is a greeting."""
    others = flows.where(~F.col("is_candidate") & (F.col("bytes_s2c") > 0))
    first = openings(segments.join(others.select(*FLOW), FLOW, "left_semi"), FLOW, "payload", "frame")
    found = others.join(first, FLOW).withColumn("port_protocol", signature(F.col("opening"))).where(F.col("port_protocol").isNotNull())
    known = flows.where(F.col("is_candidate"))
    return known.unionByName(found.drop("opening").withColumn("is_candidate", F.lit(True)))


def capture_stats(packets: DataFrame) -> DataFrame:
    """Packet count, bytes, time range and strict time order per capture.

    Order is checked inside blocks of frames and then between neighbouring blocks, so one huge capture
    is neither one task nor read twice.
    """
    blk = F.floor(F.col("frame") / FRAMES_PER_BLOCK)
    inside = Window.partitionBy("capture_id", "_blk").orderBy("frame")
    blocks = (
        packets.select("capture_id", "frame", "ts", "tcp_len", blk.alias("_blk"))
        .withColumn("_prev", F.lag("ts").over(inside))
        .groupBy("capture_id", "_blk")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("tcp_len").cast("bigint")).alias("b"),
            F.min("ts").alias("lo"),
            F.max("ts").alias("hi"),
            F.min_by("ts", "frame").alias("first"),
            F.bool_and(F.col("_prev").isNull() | (F.col("ts") >= F.col("_prev"))).alias("ordered"),
        )
    )
    before = Window.partitionBy("capture_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    chained = blocks.withColumn("_hi", F.max("hi").over(before))
    return chained.groupBy("capture_id").agg(
        F.sum("n").alias("packet_count"),
        F.sum("b").alias("data_bytes"),
        F.min("lo").alias("first_packet_at"),
        F.max("hi").alias("last_packet_at"),
        F.bool_and(F.col("ordered") & (F.col("_hi").isNull() | (F.col("first") >= F.col("_hi")))).alias("strict_time_order"),
    )


def snaplen_truncated(snaplen: Column) -> Column:
    """A snap length below a full frame lost payload; an unset one says nothing."""
    return F.coalesce(snaplen < 1500, F.lit(False))


def capture_meta(packets: DataFrame, manifest: DataFrame) -> DataFrame:
    """`capture_stats` of every capture in the manifest (capture_id, snaplen), its duration (a difference of `ts`), and whether its snap length cut
    packets short. A capture without packets has a count of 0 and no times."""
    stats = manifest.select("capture_id", "snaplen").join(capture_stats(packets), "capture_id", "left").na.fill(0, ["packet_count", "data_bytes"])
    return stats.withColumns({"duration": F.col("last_packet_at") - F.col("first_packet_at"), "snaplen_truncated": snaplen_truncated(F.col("snaplen"))})


def evidence_slice(packets: DataFrame, targets: DataFrame, block: int = SLICE_BLOCK) -> DataFrame:
    """Packets inside each target's frame window on its stream.

    `targets` = (capture, target, stream, first_frame, last_frame). The range join carries an equality on
    (capture, stream, frame block), so it hash-partitions and a hot stream spreads over its blocks.
    """
    t = targets.withColumn(
        "_blk", F.explode(F.sequence(F.floor(F.col("first_frame") / block), F.floor(F.col("last_frame") / block)))
    ).withColumnsRenamed({"first_frame": "_lo", "last_frame": "_hi"})
    p = packets.withColumn("_blk", F.floor(F.col("frame") / block))
    return p.join(t, [*FLOW, "_blk"]).where(F.col("frame").between(F.col("_lo"), F.col("_hi"))).drop("_blk", "_lo", "_hi")


def slice_manifest(sliced: DataFrame) -> DataFrame:
    """Frame count, bytes and digest per target. The digest is a hash over the hashes of frame blocks,
    so no task ever holds all frames of a slice."""
    blk = F.floor(F.col("frame") / SLICE_BLOCK)
    blocks = sliced.groupBy("capture_id", "target", blk.alias("_blk")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("tcp_len").cast("bigint")).alias("b"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("frame")), lambda x: x.cast("string")), ","), 256).alias("h"),
    )
    return blocks.groupBy("capture_id", "target").agg(
        F.sum("n").alias("frame_count"),
        F.sum("b").alias("size_bytes"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_blk", "h"))), lambda x: x["h"]), ""), 256).alias("digest"),
    )


def merkle(rows: DataFrame, keys: list[str], leaf: Column, block: int, fan: int = 1024, levels: int = 2) -> DataFrame:
    """(keys, frames, octets, digest) of frame rows: a hash over the hashes of blocks, in a tree of `levels` above them.

    Leaves are sorted by frame within a block of `block` frames, blocks within groups of `fan`, and so on, so no task holds
    more than one block or `fan` hashes, but for the last step: one hash for every block * fan ** (levels - 1) frames.
    """
    join = lambda at, of: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, of))), lambda x: x[of]), ""), 256)
    out = rows.select(*keys, "frame", F.col("tcp_len").cast("bigint").alias("b"), F.sha2(leaf, 256).alias("h"), F.floor(F.col("frame") / block).alias("at"))
    out = out.groupBy(*keys, "at").agg(F.count(F.lit(1)).alias("frames"), F.sum("b").alias("octets"), join("frame", "h").alias("h"))
    for k in range(levels):
        up = [] if k == levels - 1 else [F.floor(F.col("at") / fan).alias("up")]
        out = out.groupBy(*keys, *up).agg(F.sum("frames").alias("frames"), F.sum("octets").alias("octets"), join("at", "h").alias("h"))
        out = out.withColumnRenamed("up", "at")
    return out.withColumnRenamed("h", "digest")


def custody(packets: DataFrame, targets: DataFrame, block: int = 1024) -> DataFrame:
    """Chain-of-custody record of each target's evidence slice.

    Digest of the slice, digest of the capture it was cut from, frames, bytes and the display filter that finds them again.
    The blocks are about as wide as a window, so a packet meets only the targets around it.
    """
    from postern.operators.sessions import display_filter

    leaf = F.concat_ws("|", *[F.col(c).cast("string") for c in ("frame", "stream", "src_ip", "src_port", "dst_ip", "dst_port", "tcp_len")])
    parent = merkle(packets, ["capture_id"], leaf, block).select("capture_id", F.col("digest").alias("parent_sha256"))
    window = targets.select("capture_id", "target", display_filter(F.col("stream"), F.col("first_frame"), F.col("last_frame")).alias("display_filter"))
    cut = merkle(evidence_slice(packets, targets, block), ["capture_id", "target"], leaf, block)
    rows = cut.join(window, ["capture_id", "target"]).join(parent, "capture_id")
    return rows.select("capture_id", "target", "display_filter", F.col("frames").alias("frame_count"), F.col("octets").alias("size_bytes"), F.col("digest").alias("sha256"), "parent_sha256")


def protocol_of(flows: DataFrame) -> DataFrame:
    """Protocol and how it was identified: bytes first, port second.

    `flows` carry `server_port`, `tls_first` (a direction opened with a TLS record) and `opening`
    (first server payload).
    """
    hint = signature(F.col("opening"))
    port = dims.lookup("server_port", dims.MAIL_PORTS)
    implicit = dims.lookup("server_port", dims.IMPLICIT_TLS_PORTS)
    method = (
        F.when(F.col("tls_first") & implicit.isNotNull(), F.lit("implicit_tls_port"))
        .when(F.col("tls_first"), F.lit("tls_on_unknown_port"))
        .when(hint.isNotNull() & port.isNull(), F.lit("payload_signature_nonstandard_port"))
        .when(hint.isNotNull() & (port != hint), F.lit("payload_signature_port_mismatch"))
        .when(hint.isNotNull(), F.lit("payload_signature"))
        .when(port.isNotNull(), F.lit("port_only"))
        .otherwise(F.lit("undetected"))
    )
    protocol = F.when(F.col("tls_first"), implicit).when(hint.isNotNull(), hint).otherwise(port)
    return flows.withColumn("protocol", protocol).withColumn("detection_method", method)


def flow_counts(flows: DataFrame) -> DataFrame:
    return flows.groupBy("capture_id").agg(F.count(F.lit(1)).alias("flows"), count_if(F.col("is_candidate")).alias("candidates"))
