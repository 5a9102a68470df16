"""Readers for capture files, decoded packet tables, DNS answers and the rule policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postern import dims, schemas

# Container magic numbers
PCAP_MAGIC = {
    "A1B2C3D4": "pcap (big-endian, microsecond)",
    "D4C3B2A1": "pcap (little-endian, microsecond)",
    "A1B23C4D": "pcap (big-endian, nanosecond)",
    "4D3CB2A1": "pcap (little-endian, nanosecond)",
}
PCAPNG_MAGIC = "0A0D0D0A"
GZIP_MAGIC = "1F8B"


def container(content: Column) -> Column:
    """Container format from the first bytes, NULL when they are no capture."""
    magic = F.hex(F.substring(content, 1, 4))
    return (
        F.when(magic.isin(*PCAP_MAGIC), F.lit("pcap"))
        .when(magic == PCAPNG_MAGIC, F.lit("pcapng"))
        .when(magic.startswith(GZIP_MAGIC), F.lit("gzip"))
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, size, digest, container and byte order. Files with unknown magic have a NULL container.

    Hashing happens where the file is read and the content column is dropped there; no content is shuffled.
    """
    files = spark.read.format("binaryFile").load(path)
    magic = F.hex(F.substring("content", 1, 4))
    return files.select(
        F.col("path"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("uploaded_at"),
        F.sha2("content", 256).alias("sha256"),
        container(F.col("content")).alias("container_format"),
        dims.lookup(magic, PCAP_MAGIC).alias("byte_order"),
        (magic.startswith(GZIP_MAGIC)).alias("is_compressed"),
    )


def rejects(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("container_format").isNull())


def dedup_first(captures: DataFrame, digest: str, order: str) -> DataFrame:
    """First row of each content digest: a partial min_by, so many copies of one file stay cheap."""
    whole = F.struct(*captures.columns)
    return captures.groupBy(digest).agg(F.min_by(whole, order).alias("r")).select("r.*")


def new_captures(captures: DataFrame, registry: DataFrame, digest: str = "sha256") -> DataFrame:
    """Captures whose content is not registered yet."""
    return captures.join(registry.select(digest), digest, "left_anti")


def _number(name: str, kind: str = "bigint") -> Column:
    return F.coalesce(F.col(name).try_cast(kind), F.lit(0).cast(kind))


def _flag(name: str) -> Column:
    return F.coalesce(F.trim(name).isin("1", "True", "true"), F.lit(False))


def _filled(name: str) -> Column:
    return F.when(F.length(name) > 0, F.col(name))


def _fields(lines: DataFrame, schema, capture_id: Column | int) -> DataFrame:
    """Tab separated fields of the column `value`; fields that a line lacks are null.

    A line is made and split once: conditions on its fields are not pushed below a generator, where each would do both again.
    """
    capture = capture_id if isinstance(capture_id, Column) else F.lit(capture_id)
    cells = lines.select(capture.cast("bigint").alias("capture_id"), F.explode_outer(F.array(F.split("value", "\t"))).alias("_cells"))
    return cells.select("capture_id", *[F.try_element_at("_cells", F.lit(i + 1)).alias(name) for i, name in enumerate(schema.names)])


def read_packets(spark: SparkSession, path: str, capture_id=0) -> DataFrame:
    return parse_packets(spark.read.text(path), capture_id)


def read_segments(spark: SparkSession, path: str, streams: DataFrame | None = None, capture_id=0) -> DataFrame:
    return parse_segments(spark.read.text(path), streams, capture_id)


def read_dns(spark: SparkSession, path: str, capture_id=0) -> DataFrame:
    return parse_dns(spark.read.text(path), capture_id)


def parse_packets(lines: DataFrame, capture_id: Column | int = 0) -> DataFrame:
    """Packet index from tab separated fields. Rows without a stream or an address pair are dropped."""
    raw = _fields(lines, schemas.PACKET_FIELDS, capture_id)
    rows = raw.withColumn("src", F.coalesce(_filled("src_v4"), _filled("src_v6"))).withColumn("dst", F.coalesce(_filled("dst_v4"), _filled("dst_v6")))
    kept = rows.where(_filled("stream").isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull())
    return kept.select(
        "capture_id",
        _number("stream").alias("stream"),
        _number("frame").alias("frame"),
        _number("ts", "double").alias("ts"),
        F.col("src").alias("src_ip"),
        _number("src_port", "int").alias("src_port"),
        F.col("dst").alias("dst_ip"),
        _number("dst_port", "int").alias("dst_port"),
        _number("tcp_len", "int").alias("tcp_len"),
        _flag("syn").alias("syn"),
        _flag("fin").alias("fin"),
        _flag("rst").alias("rst"),
    )


def parse_segments(lines: DataFrame, streams: DataFrame | None = None, capture_id: Column | int = 0) -> DataFrame:
    """Payload segments from tab separated fields, limited to the wanted streams by a semi join.

    The wanted streams are a table that grows with the capture, so the join is left to the optimizer
    (it broadcasts the streams only when they are measured to be small).
    """
    raw = _fields(lines, schemas.SEGMENT_FIELDS, capture_id)
    text = F.replace(F.coalesce(F.trim("payload"), F.lit("")), F.lit(":"), F.lit(""))
    rows = raw.withColumn("src", F.coalesce(_filled("src_v4"), _filled("src_v6"))).withColumn("dst", F.coalesce(_filled("dst_v4"), _filled("dst_v6")))
    out = rows.where(_filled("stream").isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull()).select(
        "capture_id",
        _number("stream").alias("stream"),
        _number("frame").alias("frame"),
        _number("ts", "double").alias("ts"),
        F.col("src").alias("src_ip"),
        _number("src_port", "int").alias("src_port"),
        F.col("dst").alias("dst_ip"),
        _number("dst_port", "int").alias("dst_port"),
        _number("seq").alias("seq"),
        # one element, for the reason given at `_fields`
        F.explode_outer(F.array(F.when(text.rlike("^[0-9A-Fa-f]+$") & (F.length(text) % 2 == 0), F.unhex(text)))).alias("payload"),
    ).where(F.col("payload").isNotNull())
    if streams is not None:
        out = out.join(streams.select("stream").distinct(), "stream", "left_semi")
    return out


def _list(name: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(name), F.lit("")), ","), lambda x: x != "")


def parse_dns(lines: DataFrame, capture_id: Column | int = 0) -> DataFrame:
    """DNS messages from tab separated fields, multi-values as arrays, names lower-case without trailing dots."""
    raw = _fields(lines, schemas.DNS_FIELDS, capture_id)
    name = lambda c: F.regexp_replace(F.lower(c), r"\.+$", "")
    return raw.where(_filled("qname").isNotNull()).select(
        "capture_id",
        _number("frame").alias("frame"),
        _number("ts", "double").alias("ts"),
        _flag("is_response").alias("is_response"),
        name("qname").alias("qname"),
        _number("qtype", "int").alias("qtype"),
        _number("rcode", "int").alias("rcode"),
        _list("txt").alias("txt"),
        F.transform(_list("mx"), name).alias("mx"),
        _list("addresses").alias("addresses"),
        _number("answer_count", "int").alias("answer_count"),
    )


def parse_policy(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules and posture weights from policy documents in `value`: {"rules": {...}, "posture_weights": {...}}."""
    doc = texts.select(F.from_json("value", schemas.POLICY).alias("p"))
    rules = doc.select(F.explode("p.rules").alias("category", "r")).select("category", "r.*")
    rank = dims.lookup("severity", dims.SEVERITY_RANK, 9)
    rules = rules.withColumn("severity_rank", rank).withColumn("standards", F.coalesce("standards", F.array().cast("array<string>")))
    weights = doc.select(F.explode("p.posture_weights").alias("dimension", "weight")).where(F.col("weight").try_cast("double").isNotNull())
    return rules, weights.withColumn("weight", F.col("weight").cast("double"))


def load_policy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rules and posture weights of the policy document at `path`."""
    return parse_policy(spark.read.text(path, wholetext=True))
