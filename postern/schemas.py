"""Explicit schemas of the decoded inputs; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


# Tab separated fields as the packet dissector prints them
_ENDS = ("frame", "ts", "stream", "src_v4", "src_v6", "src_port", "dst_v4", "dst_v6", "dst_port")
PACKET_FIELDS = _strings(*_ENDS, "tcp_len", "syn", "fin", "rst")
SEGMENT_FIELDS = _strings(*_ENDS, "seq", "tcp_len", "payload")
DNS_FIELDS = _strings("frame", "ts", "is_response", "qname", "qtype", "rcode", "txt", "mx", "addresses", "answer_count")

RULE = T.StructType(
    [
        T.StructField("severity", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("title", T.StringType()),
        T.StructField("recommendation", T.StringType()),
        T.StructField("standards", T.ArrayType(T.StringType())),
        T.StructField("min_sessions_for_baseline", T.IntegerType()),
        T.StructField("min_advertise_ratio", T.DoubleType()),
    ]
)
POLICY = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("rules", T.MapType(T.StringType(), RULE)),
        T.StructField("posture_weights", T.MapType(T.StringType(), T.StringType())),
    ]
)
