from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsspark.llm import bpe, language_id, quality, secrets
from tests.llm.edge import edge_docs, empty_docs, prose, rows


def _expected(text):
    ids = bpe.tokenizer(bpe.RANKS)[0].encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize(("chunk", "overlap"), [(bpe.CHUNK, bpe.OVERLAP), (200, 30), (64, 5)])
def test_chunked_encoding_equals_encoding_at_once(spark, chunk, overlap):
    """Also where a run of one character is longer than the overlap, so that no stitch is found."""
    got = bpe.encode_documents(edge_docs(spark), chunk=chunk, overlap=overlap).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(
        (d or -1, *_expected(t)) for d, t, *_ in rows())


def test_round_trip_and_empty_table(spark):
    text = "a 'll  \n\n b\t漢字👍🏽 'd 12ab"
    assert bpe.decode(bpe.encode(text)).decode() == text
    assert bpe.encode_documents(empty_docs(spark)).count() == 0


def test_language_id_on_held_out_documents(spark):
    words = {"en": "the of and with from that which have this not are but".split(), "de": "der und nicht mit von dass ist auch eine werden sich".split(),
             "fr": "les des dans pour avec une est pas que sur plus mais".split()}
    r = random.Random(3)
    made = [(i, " ".join(r.choice(words[lang]) for _ in range(40)), lang) for i in range(300) for lang in [("en", "de", "fr")[i % 3]]]
    docs = spark.createDataFrame([*made, (1000, None, "en"), (1001, "", "en"), (1002, "12 !!", "en"), (1003, "nicht und der", None)],
                                 "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language_id.language_id(docs, max_docs=200).collect()}
    assert len(got) == 304
    held = [(i, lang) for i, _, lang in made if got[i].held_out]
    assert held and all(got[i].lang_pred == lang and got[i].score > 0.5 for i, lang in held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0
    assert got[1003].lang_pred == "de"
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == set(got) - {1000, 1001, 1002}


def test_language_id_defines_the_awkward_cases(spark):
    docs = edge_docs(spark)
    got = language_id.language_id(docs).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert language_id.language_id(empty_docs(spark)).count() == 0
    unlabelled = language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}
    assert language_id.keep_identified(docs).columns == docs.columns


def test_grams_stay_inside_texts():
    codes, offsets = language_id._codes(["ab", "", "c", "abc"])
    for n in (1, 2, 3):
        buckets, at = language_id._grams(codes, offsets, n)
        assert list(np.diff(at)) == [max(len(t) - n + 1, 0) for t in ("ab", "", "c", "abc")] and len(buckets) == at[-1]


def test_quality_on_held_out_documents(spark):
    r = random.Random(4)
    good = lambda i: prose(i, 40 + i % 30) + "."
    bad = lambda i: " ".join(w.upper() + "!!" for w in prose(i, 40).split()) if i % 2 else " ".join([r.choice(prose(i, 3).split())] * 30)
    made = [(i, good(i) if i % 3 else bad(i), int(i % 3 > 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in made] + [(9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in made] + [(None, 1, 0), (5, None, 0), (77777, 0, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.score_quality(docs, labels).collect()}
    held = [(i, q) for i, _, q in made if got[i].held_out]
    assert np.mean([got[i].predicted == q for i, q in held]) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got.values()) and {9000, 9001} <= set(got)


def test_quality_without_labels_and_with_awkward_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score_quality(edge_docs(spark), none).collect()
    assert len(got) == len(rows()) and {r.score for r in got} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score_quality(edge_docs(spark), one).count() == len(rows())
    assert quality.score_quality(empty_docs(spark), none).count() == 0


def test_lookup_tables_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((4000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert np.mean((model.score(x) > 0.5) == y) > 0.95 and (model.pairs[0][0], model.pairs[0][1]) == (0, 1)


ASSIGN = re.compile(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def _base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{('assign', 'access', 'hex')[k]}:{b}:{e}" for b, k, e in sorted(found)]


def test_secret_spans_against_python(spark):
    r = random.Random(9)
    key = lambda n, a="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(r.choice(a) for _ in range(n))
    texts = [t for _, t, *_ in rows()] + [
        "password: token: abcdefghijkl", "PassWord = 'abcdefghijklmn' token=short secret:\"0123456789abcdef0\"", "AKIA" + "A" * 13, "AKIAAKIA" + "Z" * 12,
        "é漢👍 api_key=" + key(20) + " tail", "0123456789abcdef" * 3, "x0123456789abcdefg", "APIKEY:" + key(12) + "." + key(5), "password=token=abcdefghijklm"]
    texts += [prose(i, 50) + " token = \"" + key(30) + "\" " + prose(i, 5) for i in range(40)]
    hidden = [prose(500 + i, 20) + " " + key(32) + " and " + prose(600 + i, 20) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts + hidden)), "doc_id long, text string")
    got = {x.doc_id: x for x in secrets.scan_secrets(docs).collect()}
    assert len(got) == len(texts) + len(hidden)
    for i, t in enumerate(texts + hidden):
        base = _base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), t
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
        spans = [x for x in got[i].spans.split(",") if x]
        assert [x for x in spans if not x.startswith("random")] == base
        assert spans == sorted(spans, key=lambda x: (int(x.split(":")[1]), secrets.KINDS.index(x.split(":")[0])))
    found = [got[len(texts) + i].n_random for i in range(len(hidden))]
    assert sum(found) >= 18  # random strings that no base rule names
    assert sum(got[i].n_random for i, t in enumerate(texts[:55]) if t and len(t) < 10_000 and not _base(t)) == 0


def test_a_hidden_token_is_found_however_often_it_comes(spark):
    """One in a third of the rows between different words, one in a passage that is copied."""
    r = random.Random(10)
    key = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    hidden, passage = key(32), prose(1, 8) + " " + key(32) + " " + prose(2, 8)
    long_ = ["/".join(prose(i, 3).split()) + "-service" for i in range(30)]
    docs = [(i, prose(700 + i, 30) + (f" {hidden} " if i % 3 == 0 else f" {passage} " if i % 3 == 1 else f" token={key(24)} {long_[i % 30]} ")
             + prose(2000 + i, 30)) for i in range(600)]
    got = {x.doc_id: x.n_random for x in secrets.scan_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[i] == (i % 3 < 2) for i in got)


def test_secret_scan_of_an_empty_table_and_extra_columns(spark):
    assert secrets.scan_secrets(empty_docs(spark)).count() == 0
    assert secrets.scan_secrets(edge_docs(spark)).count() == len(rows())
