"""Packed sequences against whole-text encoding and the lower bound of their number."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skerry.llm.packing import Encoder, best_fit, pack_documents, plan_by_fill

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, piece string"
ENCODER, WHOLE = Encoder(PATH), Tokenizer.from_file(PATH)


@given(st.text(st.characters(max_codepoint=0x260, exclude_categories=["Cs"]), max_size=60) | st.text(" \t\n\x0b\x1c\x85\xa0'stla1é|<endoftext>", max_size=40) | st.just("a <|endoftext|> b"))
@settings(max_examples=600, deadline=None)
def test_ids_are_the_tokenizers(text):
    assert np.frombuffer(ENCODER(text), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 20), max_size=80))
@settings(deadline=None)
def test_best_fit_and_plan(lengths):
    bins = best_fit(lengths, 20)
    assert sorted(k for b in bins for k in b) == list(range(len(lengths))) and all(sum(lengths[k] for k in b) <= 20 for b in bins)
    count = {n: lengths.count(n) for n in lengths}
    used = defaultdict(int)
    for members, times in plan_by_fill(count, 20):
        assert sum(members) <= 20 and times > 0
        for f in members:
            used[f] += times
    assert used == count


def test_sequences_are_whole_and_few(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(["alpha", "bé", "c,", "the", "\n"], k=int(rng.paretovariate(0.6)) % 900)), "x") for k in range(700)]
    rows += [rows[4], (None, "null id", ""), (800, None, ""), (801, "", ""), (802, "long text " * 9000, ""), (803, " ".join(["x"] * 1023), "")]
    out = pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(5), PATH).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, text, _ in rows:
        ids = np.array([*WHOLE.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by_doc[doc], key=lambda r: (r.piece, r.sequence_id))
        copies = 2 if doc == rows[4][0] else 1
        assert sum(r.length for r in pieces) == copies * len(ids)
        for r in pieces:
            assert r.length <= 1024 and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            assert r.length == 1024 or r.piece == 0
    for got in by_sequence.values():
        at = 0
        for r in sorted(got, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_sequence) <= -(-sum(r.length for r in out) // 1024) + 2


def test_empty_table(spark):
    assert not pack_documents(spark.createDataFrame([], SCHEMA), PATH).collect()


def test_pieces_of_equal_length(spark):
    """Ties everywhere: 64 documents of a half each and 40 of a quarter fill whole sequences."""
    rows = [(k, " ".join(["x"] * 511), "") for k in range(64)] + [(100 + k, " ".join(["x"] * 255), "") for k in range(40)]
    out = pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(6), PATH).collect()
    assert {r.length for r in out} == {512, 256} and len({r.sequence_id for r in out}) == 42
