"""Token files, chat formatting and SentencePiece: round trips, and equality with the libraries."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postern import session
from postern.llm import chat, pieces, token_files
from tests.llm.helpers import SCHEMA, documents, odd_texts, prose

TRICKY = ["  a", "a ", "a\n\nb", "\n", "a\tb c", "x\r\ny z", "it's  don't", "<|endoftext|> a", "　a b", "a\x1cb c", "😀 é ́", "\\ \\- <s> [INST]", "▁a ▁", " ", "a\nb\nc d's 12 3,4\n5"]


def test_token_files_hold_the_librarys_ids(spark):
    docs = documents(spark, [*odd_texts(), *TRICKY])
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1]))
    enc = token_files.encoder(token_files.default_tokenizer())
    want, at = [], 0
    for d, t in rows:
        ids = np.array([*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted((tuple(r) for r in token_files.round_trip(docs).collect()), key=lambda r: r[1])
    assert got == want


def test_token_files_are_read_one_task_a_part_and_cleared(spark, tmp_path):
    docs = documents(spark, [prose(400, i) for i in range(40)], dup=False)
    path = token_files.default_tokenizer()
    (tmp_path / ".left-by-a-lost-task.ids").write_bytes(b"x")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = token_files.write(docs, str(tmp_path), tokenizer=path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    n = parts.count()
    assert n > 1 and not [f for f in tmp_path.iterdir() if f.name.startswith(".")]
    back = token_files.read(parts, token_files.encoder(path).dtype.str).withColumn("task", F.spark_partition_id())
    assert back.select("task").distinct().count() == n and back.count() == 40
    session.clear_staged(spark)
    token_files.round_trip(docs).count()
    assert session.clear_staged(spark) == 1


def test_token_files_hold_the_ids_of_added_tokens_by_default(spark):
    from tokenizers import Tokenizer

    texts = ["x <|endoftext|> y", "a b<|endoftext|>c d", "<|endoftext|>", "a <|endoftext|>\n<|endoftext|> b", "plain words <|endoftext |> here", "no such token"]
    library = Tokenizer.from_file(token_files.default_tokenizer())
    want, at = [], 0
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert library.encode(texts[0], add_special_tokens=False).ids == [87, 220, 50256, 331]
    got = token_files.round_trip(documents(spark, texts, dup=False)).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want


def test_token_files_of_an_empty_table(spark):
    assert token_files.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


ROLES = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "user TURN>> <<TURN x"]


def turns(spark):
    r = random.Random(4)
    bits = [*chat.INST.controls, "\\", "\\-", "<", "[", "[[INST]]", "<<s>", "é\n", "ok ", "<</SYS>>\n\n", " </s>", "TURN>>"]
    rows = [(c, t, r.choice(ROLES), None if r.random() < 0.1 else "".join(r.choice(bits) for _ in range(r.randint(0, 12))), "clash") for c in range(40) for t in range(r.randint(1, 9))]
    rows += [rows[0], (None, 0, "user", "x", None), (50, 0, "user", "a", None), (50, 1, "assistant", "b", None), (51, None, "user", "n", None), (51, 0, "assistant", "m", None)]
    return rows, spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, loss string").repartition(3)


def test_chat_round_trip(spark):
    rows, df = turns(spark)
    by: dict = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), (role is not None, role or ""), (text is not None, text or "")))
    out = {r.conv_id: r for r in chat.read_back(chat.segments(df)).collect()}
    assert set(out) == set(by)
    for c, own in by.items():
        plain = [(role[1], text[1]) for _, role, text in sorted(own)]
        loss = "".join(t for r, t in plain if r == "assistant")
        formatted = "".join("".join(chat.INST.render(r, t)[:3]) for r, t in plain)
        assert chat.INST.parse(formatted) == plain
        assert (out[c].n_turns, out[c].loss_chars, out[c].formatted_chars) == (len(plain), len(loss), len(formatted))
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in plain).encode()).hexdigest()
        assert out[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        state, good = "start", True
        for r, _ in plain:
            good, state = good and r in chat.INST.steps.get(state, ()), r
        assert out[c].valid == (good and state in chat.INST.ends)


def test_no_control_string_is_left_in_an_escaped_text():
    r = random.Random(9)
    bits = [*chat.INST.controls, "\\", "-", "<", "s>", "[", "INST]", "/"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 9)))
        made = chat.INST.escape(text)
        assert chat.unescape(made) == text and not any(c in made for c in chat.INST.controls)


def test_chat_of_an_empty_table(spark):
    assert chat.read_back(chat.segments(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).count() == 0


@pytest.mark.parametrize("chunk", [50, 400, pieces.CHUNK])
def test_pieces_are_the_librarys(spark, chunk):
    lib = pieces.pieces(pieces.default_model()).lib
    unbroken = ["".join(random.Random(i).choice("thereandéß日x0-") for _ in range(700)) for i in range(3)]
    docs = documents(spark, [*odd_texts(), *TRICKY, *unbroken, prose(60, 1) + " " + unbroken[0] + " " + prose(60, 2)])
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    encoded = pieces.encode(docs, chunk=chunk)
    got = sorted(((r.doc_id, list(r.ids)) for r in encoded.collect()), key=str)
    assert got == sorted(((d, lib.encode(t)) for d, t in texts), key=str)
    back = sorted(((r.doc_id, r.text) for r in pieces.decode(encoded, ["doc_id"]).collect()), key=str)
    assert back == sorted(((d, t.replace("▁", " ")) for d, t in texts), key=str)


def test_max_plus_product_is_associative_and_blocks_agree():
    m, text = pieces.pieces(pieces.default_model()), pieces.marked("".join(random.Random(2).choice("thearn") for _ in range(300)))
    edges = [0, *range(20, 300, 20), len(text)]
    chain = []
    for a, b in zip(edges, edges[1:]):
        found = m.paths(text, a, b, [pieces.START] if a == 0 else m.states(text, a), b == len(text))
        chain.append(dict.fromkeys((s, pieces.START) for s, _ in found) if b == len(text) else found)
    a, b, c = chain[:3]
    assert pieces.product(pieces.product(a, b), c) == pieces.product(a, pieces.product(b, c))
    assert pieces.resolve(chain, pieces.START, pieces.START, 4) == pieces.resolve(chain, pieces.START, pieces.START, 100)


def test_pieces_of_an_empty_table(spark):
    assert pieces.encode(spark.createDataFrame([], SCHEMA)).count() == 0
