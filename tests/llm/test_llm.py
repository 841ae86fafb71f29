import io
import itertools
import random
import zlib

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")
from quarry.llm import common, decontaminate, licenses, packing, passages, pii, quality_classifier, quality_rules, simhash, token_files, warc  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, w string, fp string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i is None or i % 2 else None, "s", 1, "k", "w", "f") for i, t in texts], DOC)


WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(random.Random(1).choices(WORDS, k=3000))
EDGE = [(0, None), (1, ""), (2, "  \n "), (3, "one"), (4, "two words"), (5, LONG), (6, LONG), (6, LONG), (None, "no id here at all"), (7, LONG + " tail")]


def test_simhash_matches_brute_force(spark):
    got = simhash.components(docs(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    fps = {i: int.from_bytes(simhash.fingerprint(t, 3), "big") for i, t in EDGE if i is not None}
    comp = {i: i for i in fps}
    for _ in fps:
        for a, b in itertools.combinations(fps, 2):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                comp[a] = comp[b] = min(comp[a], comp[b])
    assert all(r["component_id"] == comp[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert comp[0] == comp[2] == 0


def test_long_lists_lose_no_link(spark):
    rng = np.random.RandomState(0)
    base, rows = rng.bytes(64), []
    for i in range(1500):
        fp = bytearray(base)
        fp[rng.randint(64)] ^= 1 << rng.randint(8)
        rows.append((i, bytes(fp)))
    reps = spark.createDataFrame(rows, "node long, fp binary").dropDuplicates(["fp"])
    comp = common.connected_components(simhash.links(reps, simhash.spread_triples(64, 12), 102)).collect()
    assert len({r["root"] for r in comp}) == 1 and len(comp) == reps.count()


def test_mixed_long_list_keeps_links_between_labels(spark, monkeypatch):
    """A list of tight groups, strangers and chains, cut into many blocks, has the components of all pairs."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = np.random.RandomState(5)
    bits = [rng.randint(0, 2, 512) for _ in range(4)]
    rows = []
    for n, (base, size, flips) in enumerate(zip([0, 0, 1, 2, 3], [60, 30, 20, 1, 1], [4, 80, 90, 0, 0])):
        for _ in range(size):
            x = bits[base].copy()
            x[24 + rng.choice(488, flips, replace=False)] ^= 1
            x[:24] = 1  # all meet in one list
            rows.append(x)
    fps = [np.packbits(x).tobytes() for x in rows]
    reps = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(fps)], "node long, fp binary")
    found = simhash.links(reps, [(0, 1, 2)], 102)
    root = {r["node"]: r["root"] for r in common.connected_components(found).collect()}
    near = lambda a, b: (rows[a] != rows[b]).sum() <= 102
    want = list(range(len(rows)))
    for _ in range(len(rows)):
        want = [min([want[i]] + [want[j] for j in range(len(rows)) if near(i, j)]) for i in range(len(rows))]
    assert [root.get(i, i) for i in range(len(rows))] == want


def test_near_duplicates_keep_one(spark):
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs(spark, EDGE)).collect()}
    assert kept == {0, 3, 4, 5, None}


def test_empty_tables(spark):
    e = docs(spark, [])
    assert simhash.components(e).count() == 0 and quality_rules.rules(e).count() == 0 and passages.repeats(e).count() == 0
    assert packing.pack(e, public.path("word_bpe_49k.json")).count() == 0 and token_files.round_trip(spark, e, public.path("byte_bpe_50k.json")).count() == 0
    assert pii.pseudonymise(e, b"k").count() == 0
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(e, b).count() == 0 and decontaminate.scan(docs(spark, EDGE), b).filter("n_items > 0").count() == 0


def test_edge_rows_pass_through(spark):
    d, n = docs(spark, EDGE), len(EDGE)
    from pyspark.sql import functions as F

    assert quality_rules.rules(d).count() == n and pii.pseudonymise(d, b"k").count() == n
    assert licenses.scan(d, F.concat_ws("/", "source", "doc_id")).count() == n
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.drop_low_quality(d, labels).count() == n
    assert decontaminate.scan(d, spark.createDataFrame([(1, "two words"), (None, None)], "item_id long, text string")).filter("n_items = 1").count() == 1


def test_passages_find_planted(spark):
    rng = random.Random(2)
    p = " ".join(rng.choices([f"p{i}" for i in range(900)], k=60))
    fill = lambda k: " ".join(random.Random(k).choices([f"f{i}" for i in range(5000)], k=150))
    got = passages.repeats(docs(spark, [(1, f"{fill(1)} {p} {fill(2)}"), (2, f"{p} {fill(3)}"), (3, fill(4))])).collect()
    assert {r["doc_id"] for r in got} == {1, 2}
    one = next(r for r in got if r["doc_id"] == 2)
    assert (one["first_word"], one["last_word"], one["ref_doc_id"], one["ref_first_word"]) == (0, 59, 1, 150)


def test_compact_windows_partition_all_subsequences():
    v = np.random.RandomState(3).permutation(40).astype(np.uint64)
    w = passages.compact_windows(v, 1)
    for i, j in itertools.combinations_with_replacement(range(40), 2):
        assert [c for a, c, b in w if a <= i <= c <= j <= b] == [i + int(v[i : j + 1].argmin())]


def test_surrogates():
    key = b"secret"
    for kind, value in [("phone", "+1 (377) 555-0271"), ("card", "4111 1111 1111 1111"), ("ip", "10.0.0.1"), ("email", "Ann.Lee@mail.example.com"), ("name", "Mrs. Anna Petrova"), ("secret", "a" * 40)]:
        new = pii.surrogate(key, kind, value)
        assert new != value and (kind == "ip" or len(new) == len(value) or kind == "name")
    assert pii.surrogate(key, "phone", "377-555-0271") == "-".join([x for x in [pii.surrogate(key, "phone", "+1 (377) 555-0271")][0].replace("+1 (", "").replace(") ", "-").split("-")])
    assert pii.surrogate(key, "name", "Anna Petrova").split()[0] in pii.GIVEN["latin", "f"]
    seen = {pii.derange(key, "t", x, 500) for x in range(500)}
    assert seen == set(range(500)) and all(pii.derange(key, "t", x, 500) != x for x in range(500))


def test_token_file_reads_only_what_is_asked():
    out = io.BytesIO()
    w = token_files.Writer(out, "<u2")
    texts = [np.arange(n, dtype="<u2").tobytes() for n in (3, 0, 50_000, 7, 30_000, 30_000)]
    for i, t in enumerate(texts):
        w.add(i if i else None, t)
    w.close()
    r = token_files.Reader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert r.ids == [None, 1, 2, 3, 4, 5] and r.document(3) == texts[3] and r.frames_read == 1
    assert [r.document(i) for i in range(6)] == texts
    broken = bytearray(out.getvalue())
    broken[5] ^= 255
    with pytest.raises(Exception):
        token_files.Reader(io.BytesIO(bytes(broken)), len(broken)).document(0)


def test_packing_is_gapless(spark):
    rows = packing.pack(docs(spark, EDGE), public.path("word_bpe_49k.json")).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["ids_crc32"], r["ids"]))
    for pieces in by.values():
        at = 0
        for offset, length, crc, ids in sorted(pieces):
            assert offset == at and crc == zlib.crc32(np.frombuffer(bytes(ids), "<u2").astype("<u4").tobytes())
            at += length
        assert at == 4096 or at & (at - 1) == 0
    assert sum(r["length"] for r in rows if r["start"] == 0 and r["doc_id"] == 5) > 0


def test_hilbert_neighbours_touch():
    grid = np.array(list(itertools.product(range(8), repeat=2)))
    order = grid[np.argsort(packing.hilbert(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/x", "same"), (2, None, "same"), (2, None, "same"), (3, "http://b", None), (None, "u", "same"), (4, "u", "ünï\r\n\r\nx")], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    rows = warc.assemble(warc.read_records(warc.write(pages, folder), folder)).collect()
    assert len(rows) == 6 and all(r["request"] and r["metadata"] and r["n_records"] == 3 for r in rows)
    kinds = sorted((r["response"]["warc_type"], r["response"]["payload_bytes"]) for r in rows)
    assert kinds == [("response", 0), ("response", 4), ("response", 4), ("response", 10), ("revisit", 4), ("revisit", 4)]


def test_classifier_learns(spark):
    good = [(i, " ".join(random.Random(i).choices(WORDS, k=80))) for i in range(60)]
    bad = [(i, "###$$$ " * 80) for i in range(60, 80)]
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i, _ in (good + bad)[::2]], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality_classifier.drop_low_quality(docs(spark, good + bad), labels).collect()}
    assert kept == set(range(60))


def test_decontamination_measures_each_item(spark):
    """Short items contained once and items with one changed word drop their document; windows of two items do not add up."""
    word = lambda p, k: [f"{p}{i}" for i in range(k)]
    items = [word(p, k) for p, k in [("a", 8), ("b", 12), ("c", 15), ("d", 3), ("e", 16), ("f", 20), ("g", 40), ("h", 40)]]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    around = lambda *parts: " ".join([*word("x", 9), *itertools.chain(*[[*p, *word("y", 9)] for p in parts])])
    changed = lambda w, at: [*w[:at], "changed", *w[at + 1 :]]
    bad = [around(w) for w in items] + [around(changed(w, at)) for w in items[4:6] for at in (0, 7, 8)]
    clean = [around(items[6][:8], items[7][:8]), around(items[6][:8], items[6][:8]), around(items[5][:8]), around(items[0][:7])]
    rows = docs(spark, list(enumerate(bad + clean)))
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(rows, bench).collect()} == set(range(len(bad), len(bad + clean)))


def test_passages_that_agree_in_one_hash_are_found(spark):
    """Passages of Jaccard 45 / 55 that share one of the four min-hashes are reported."""
    least = passages.MIN_WORDS - passages.NGRAM + 1

    def agree(a, b):
        keys = lambda t, j: {int(v[c]) for v in [passages._mix(passages.shingles(t), j + 1)] for _, c, _ in passages.compact_windows(v, least)}
        return sum(bool(keys(a, j) & keys(b, j)) for j in range(4))

    def pair(seed):
        w = [f"q{seed}x{i}" for i in range(54)]
        return " ".join(w), " ".join([*w[:26], "changed", *w[27:]])

    seeds = [s for s in range(600) if agree(*pair(s)) == 1][:3]
    assert len(seeds) == 3
    rows = docs(spark, [(2 * n + i, t) for n, s in enumerate(seeds) for i, t in enumerate(pair(s))])
    assert {r["doc_id"] for r in passages.repeats(rows).collect()} == set(range(6))
