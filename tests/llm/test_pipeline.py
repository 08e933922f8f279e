"""The pipeline against the same five stages done by hand."""
import collections
import hashlib
import math
import os
import re

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from binlake.llm import bpe, mixing, rules, secrets

from .test_documents import base, base_spans, linked_by_hand

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


def fails(line):
    bars, phrases = len(re.findall(rules.MENU, line)), len(line) - len(re.sub(rules.BOILERPLATE, "", line))
    return (not (re.search(rules.TERMINAL, line) or re.search(rules.SENTENCE_END, line)) or len(re.findall(rules.NOISE, line)) * 40 > len(line)
            or bars >= 3 and bars * rules.MENU_SPAN >= len(line) or re.search(rules.MENU_WORD, line) is not None
            or phrases > 0 and phrases * rules.PHRASE_SHARE >= len(line))


def cleaned(text):
    """Text without failed lines, or None if rejected."""
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    good = [x for x in lines if not fails(x)]
    whole = sum(map(len, lines))
    if base(text)[5] or 1 - sum(map(len, good)) / max(whole, 1) > rules.MAX_LOSS:
        return None
    return text if len(good) == len(lines) else "\n".join(good)


def masked(text):
    out, at = "", 0
    for begin, _, end in base_spans(text):
        if begin > at or not out:
            out += text[at:begin] + secrets.MASK
        at = max(at, end)
    return out + text[at:] if out else text


def rows_of_mix(counts):
    """Rows each source sends, by simulating every slot."""
    total = sum(n ** mixing.TEMPER for n in counts.values())
    q = {s: max(1, round(n ** mixing.TEMPER / total * mixing.PERIOD)) for s, n in counts.items()}
    period, sent, slot = sum(q.values()), collections.Counter(), 0
    while any(sent[s] * mixing.BLOCK < n for s, n in counts.items()):
        ready = [(math.ceil((sent[s] + 1) * period / q[s]), s) for s in sorted(q) if sent[s] * period // q[s] <= slot]
        sent[min(ready)[1]] += 1
        slot += 1
    return {s: k * mixing.BLOCK for s, k in sent.items()}


def test_run(spark):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(bpe.vocabulary())
    docs = {r["doc_id"]: r for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}
    texts = {i: t for i, r in docs.items() if (t := cleaned(r["text"] or "")) is not None}
    group = linked_by_hand(texts, 5, 80)
    texts = {i: masked(t) for i, t in texts.items() if group[i][1] == i}
    want = {}
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in got} == set(want)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.doc_id] for r in got)
    of = collections.Counter(docs[i]["source"] for i in texts)
    assert collections.Counter(docs[r.doc_id]["source"] for r in got) == rows_of_mix(of)
    times = collections.Counter(r.doc_id for r in got)
    for s in of:
        mine = [times[i] for i in texts if docs[i]["source"] == s]
        assert max(mine) - min(mine) <= 1


def test_every_stage_takes_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == 0
