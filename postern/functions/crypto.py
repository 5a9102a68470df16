"""Cipher-suite decomposition, GREASE filtering and TLS fingerprints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern import dims

SUITE_FACTS = ["key_exchange", "authentication", "encryption", "key_size", "mode", "mac_hash", "forward_secrecy", "aead", "weaknesses"]


def suite_facts(df: DataFrame, name: str = "cipher_suite") -> DataFrame:
    """Add what a suite name says. TLS 1.3 names carry no key exchange or authentication."""
    suite = F.col(name)
    body = F.regexp_replace(suite, "^TLS_", "")
    legacy = F.contains(body, F.lit("_WITH_"))
    left = F.split(F.get(F.split(body, "_WITH_"), F.lit(0)), "_")
    cipher = F.split(F.when(legacy, F.get(F.split(body, "_WITH_"), F.lit(1))).otherwise(body), "_")
    encryption = F.get(cipher, F.lit(0))
    kex = F.when(legacy, F.get(left, F.lit(0)))
    second = F.get(cipher, F.lit(1))
    has_second = F.when(legacy, F.size(cipher) > 1).otherwise(F.size(cipher) > 2)
    mode = F.when(legacy, F.get(F.filter(cipher, lambda t: t.isin("GCM", "CBC", "CCM", "POLY1305")), F.lit(0))).otherwise(
        F.when(F.size(cipher) > 2, F.get(cipher, F.size(cipher) - 2))
    )
    notes = [F.when(F.contains(suite, F.lit(t)), F.lit(t)) for t in dims.WEAK_TOKENS]
    notes += [F.when(F.contains(suite, F.lit("_CBC_")), F.lit("CBC")), F.when(kex == "RSA", F.lit(dims.NO_FORWARD_SECRECY_NOTE))]
    known = suite.isNotNull()
    return df.withColumns(
        {
            "key_exchange": kex,
            "authentication": F.when(legacy, F.coalesce(F.get(left, F.lit(1)), F.get(left, F.lit(0)))),
            "encryption": encryption,
            "key_size": F.when(has_second & second.rlike("^[0-9]+$"), second.try_cast("int"))
            .when(encryption == "CHACHA20", F.lit(256))
            .when(encryption == "3DES", F.lit(168)),
            "mode": mode,
            "mac_hash": F.get(cipher, F.size(cipher) - 1),
            "forward_secrecy": F.when(known, F.when(legacy, kex.isin(*dims.FORWARD_SECRET_KEX)).otherwise(F.lit(True))),
            "aead": F.when(known, F.when(legacy, F.coalesce(mode.isin(*dims.AEAD_MODES), F.lit(False))).otherwise(F.lit(True))),
            "weaknesses": F.when(known, F.array_compact(F.array(*notes))),
        }
    )


def dim_suite(spark) -> DataFrame:
    return suite_facts(dims.suites(spark))


def decorate(sessions: DataFrame) -> DataFrame:
    """Join the 33-row suite dimension to the sessions (bounded by the registry, so broadcast)."""
    dim = dim_suite(sessions.sparkSession)
    return sessions.join(F.broadcast(dim), "cipher_suite", "left").withColumnRenamed("code", "cipher_code")


def is_grease(value: Column) -> Column:
    low = value.bitwiseAND(F.lit(0xFF))
    return (value.bitwiseAND(F.lit(0x0F0F)) == F.lit(0x0A0A)) & (F.shiftright(value, 8).bitwiseAND(F.lit(0xFF)) == low)


def drop_grease(array: Column) -> Column:
    return F.filter(array, lambda v: ~is_grease(v))


def _dashes(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda v: v.cast("string")), "-")


def ja3_text(version: Column, suites: Column, exts: Column, groups: Column, points: Column) -> Column:
    return F.concat_ws(",", version.cast("string"), _dashes(suites), _dashes(exts), _dashes(groups), _dashes(points))


def ja3s_text(version: Column, suite: Column, exts: Column) -> Column:
    return F.concat_ws(",", version.cast("string"), suite.cast("string"), _dashes(exts))


def _hex4(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 4, "0"))


def _short_hash(values: Column) -> Column:
    joined = F.array_join(values, ",")
    return F.when(F.size(values) == 0, F.lit("0" * 12)).otherwise(F.substring(F.sha2(joined, 256), 1, 12))


def _count2(array: Column) -> Column:
    return F.lpad(F.least(F.size(array), F.lit(99)).cast("string"), 2, "0")


def _alpn2(alpn: Column) -> Column:
    return F.when(alpn.isNull() | (F.length(alpn) == 0), F.lit("00")).otherwise(F.concat(F.substring(alpn, 1, 1), F.substring(alpn, -1, 1)))


def _version2(code: Column) -> Column:
    # JA4 version labels
    return F.coalesce(dims.lookup(code, {0x0304: "13", 0x0303: "12", 0x0302: "11", 0x0301: "10", 0x0300: "s3"}), F.lit("00"))


def ja4(max_version: Column, sni: Column, suites: Column, exts: Column, alpn: Column, sig_algs: Column) -> Column:
    """Client fingerprint: sorted lists, SNI and ALPN kept out of the extension hash."""
    ciphers = F.transform(drop_grease(suites), _hex4)
    extensions = F.transform(drop_grease(exts), _hex4)
    hashed = F.array_sort(F.filter(extensions, lambda e: ~e.isin("0000", "0010")))
    sigs = F.transform(drop_grease(sig_algs), _hex4)
    return F.concat(
        F.lit("t"),
        _version2(max_version),
        F.when(sni.isNotNull() & (F.length(sni) > 0), F.lit("d")).otherwise(F.lit("i")),
        _count2(ciphers),
        _count2(extensions),
        _alpn2(alpn),
        F.lit("_"),
        _short_hash(F.array_sort(ciphers)),
        F.lit("_"),
        _short_hash(F.concat(hashed, sigs)),
    )


def ja4s(version: Column, suite: Column, exts: Column, alpn: Column) -> Column:
    extensions = F.transform(drop_grease(exts), _hex4)
    return F.concat(
        F.lit("t"), _version2(version), _count2(extensions), _alpn2(alpn), F.lit("_"), _hex4(suite), F.lit("_"), _short_hash(F.array_sort(extensions))
    )


def ja4_parts(ja4_text: Column) -> Column:
    """Struct of cipher count, extension count, SNI and ALPN flags; all empty below 10 characters."""
    head = F.get(F.split(ja4_text, "_"), F.lit(0))
    ok = F.coalesce(F.length(ja4_text) >= 10, F.lit(False))
    ciphers = F.substring(head, 5, 2).try_cast("int")
    exts = F.substring(head, 7, 2).try_cast("int")
    readable = ok & ciphers.isNotNull() & exts.isNotNull()
    return F.struct(
        F.when(readable, ciphers).otherwise(F.lit(0)).alias("ciphers"),
        F.when(readable, exts).otherwise(F.lit(0)).alias("extensions"),
        F.when(ok, F.substring(head, 4, 1) == "d").otherwise(F.lit(False)).alias("sni"),
        F.when(ok, ~F.substring(head, 9, 2).isin("00", "")).otherwise(F.lit(False)).alias("alpn"),
    )


def version_name(code: Column) -> Column:
    return dims.lookup(code, dims.VERSION_CODE)


def group_name(code: Column) -> Column:
    named = dims.lookup(code, dims.GROUP_NAMES)
    return F.when(code.isNotNull(), F.coalesce(named, F.concat(F.lit("unknown (0x"), F.lpad(F.hex(code), 4, "0"), F.lit(")"))))
