"""Repeated rows, nulls, large ids and clashing names, in several partitions."""

import random
import zlib

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")
from quarry.llm import packing, quality_classifier, simhash, token_files, warc  # noqa: E402

BIG = 2**62 + 1


def rows_of(df):
    return sorted(df.collect(), key=lambda r: tuple((v is not None, v) for v in r))


def test_warc_keeps_every_repeated_row(spark, tmp_path):
    schema = "page_id long, url string, html string"
    data = [(4, "u", "x")] * 5 + [(2, "u", "x")] * 3 + [(None, None, "x")] * 2 + [(None, "u", None)] * 2 + [(BIG, "u", "y")]
    random.Random(1).shuffle(data)
    pages = spark.createDataFrame(data, schema).repartition(6)
    folder = f"file://{tmp_path}/w"
    got = warc.assemble(warc.read_records(warc.write(pages, folder), folder)).collect()
    assert len(got) == len(data) and all(r["n_records"] == 3 and r["request"] and r["metadata"] for r in got)
    by = {}
    for r in got:
        page = bytes(r["metadata"]["payload"]).decode().split(": ")[1].strip()
        by.setdefault((page, r["response"]["warc_type"]), []).append(r["response"]["refers_to"])
    assert {k: len(v) for k, v in by.items()} == {("4", "response"): 5, ("2", "revisit"): 3, ("null", "revisit"): 2, ("null", "response"): 2, (str(BIG), "response"): 1}
    named = {r["response"]["record_id"] for r in got}
    assert all(x in named for v in by.values() for x in v if x)
    empty = warc.write(spark.createDataFrame([], schema), folder)
    assert warc.read_records(empty, folder).count() == 0


DOCS = [(BIG, "same text here"), (BIG, "same text here"), (None, "same text here"), (None, None), (3, ""), (-7, "ünï cödé " * 3000), (5, "a b c. d, e\n" * 40)]


def want(name, end):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path(name))
    return [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, end], "<u4")) for i, t in DOCS]


def test_token_files_return_the_library_ids(spark):
    d = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    got = token_files.round_trip(spark, d, public.path("byte_bpe_50k.json")).collect()
    full = want("byte_bpe_50k.json", 0)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(i), len(x), zlib.crc32(x.tobytes())) for i, x in full)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == [None, None, -7, 3, 5, BIG, BIG]


def test_packing_returns_the_library_ids_and_repeats_itself(spark):
    d = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    once, again = (packing.pack(d, public.path("word_bpe_49k.json"), part_tokens=2000).collect() for _ in range(2))
    assert sorted(map(str, once)) == sorted(map(str, again))
    left = sorted((str(i), x.tobytes()) for i, x in want("word_bpe_49k.json", 2))
    pieces = {}
    for r in once:
        pieces.setdefault((str(r["doc_id"]), r["doc_tokens"], r["start"]), []).append(np.frombuffer(bytes(r["ids"]), "<u2").astype("<u4").tobytes())
    found = []
    for i, n in sorted({k[:2] for k in pieces}):
        runs = [pieces[i, n, 0].pop() for _ in list(pieces[i, n, 0])]
        for run in runs:
            while len(run) < 4 * n:
                run += pieces[i, n, len(run) // 4].pop()
            found.append((i, run))
    assert sorted(found) == left


def test_packing_parts_are_bounded():
    cells = [(c, n) for c, n in enumerate([10, 20, 500, 5, 5, 90, 100])]
    got = packing.parts(cells, 100)
    assert got == [(0, 0, 1), (1, 0, 1), (2, 1, 5), (3, 6, 1), (4, 6, 1), (5, 6, 1), (6, 7, 1)]
    assert packing.parts([], 100) == []


def test_null_ids_link_others(spark):
    """A row without an id bridges two fingerprints and gets their component."""
    words = [f"w{i}" for i in range(4000)]
    base = " ".join(random.Random(3).choices(words, k=300))
    data = [(9, base), (None, base + " x"), (12, base + " x y")]
    got = simhash.components(spark.createDataFrame(data, "doc_id long, text string"), max_bits=20).collect()
    assert {r["component_id"] for r in got} == {9}
    alone = simhash.components(spark.createDataFrame([(None, "only one"), (None, "only one")], "doc_id long, text string")).collect()
    assert [r["component_id"] for r in alone] == [None, None]


@pytest.mark.parametrize("name", ["path_n", "path_good", "s_host", "s_path", "k_path", "host", "path", "site", "own", "q_keep", "keep"])
def test_classifier_survives_clashing_names(spark, name):
    d = spark.createDataFrame([(1, "some words here", "s", "en", "mine")], f"doc_id long, text string, source string, lang string, {name} string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    out = quality_classifier.drop_low_quality(d, labels)
    assert out.columns == d.columns and [r[name] for r in out.collect()] == ["mine"]
    if name == "path_n":
        assert quality_classifier.drop_low_quality(d.limit(0), labels.limit(0)).count() == 0
