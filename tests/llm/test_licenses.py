"""Versions, SPDX lines, wrapped headers and inheritance."""

from pyspark.sql import functions as F

from quarry.llm import decontaminate, licenses

GPL2 = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version."
MIT = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software, to deal in the software\nwithout restriction."


def test_versions_and_wrapped_headers(spark):
    data = [
        (1, GPL2, "a/x.c"), (2, GPL2.replace("version 2", "version 3"), "b/x.c"), (3, "SPDX-License-Identifier: MIT\nint x;", "c/x.c"),
        (4, "licensed under the GNU Affero General Public License, version 3", "d/x.c"), (5, MIT, "e/LICENSE"), (6, "plain words", "e/sub/y.c"),
        (7, "SPDX-License-Identifier: Zzz-9", "f/x.c"), (8, None, "e/z.c"), (9, "plain words", None), (9, "plain words", None), (10, "", "x.c"),
    ]
    d = spark.createDataFrame(data, "doc_id long, text string, path string").withColumn("key", F.lit(1)).withColumn("line", F.lit("x"))
    got = licenses.scan(d, F.col("path")).collect()
    assert len(got) == len(data)
    own = {r["doc_id"]: r["license"] for r in got}
    assert own == {1: "GPL-2.0", 2: "GPL-3.0", 3: "MIT", 4: "AGPL-3.0", 5: "MIT", 6: None, 7: None, 8: None, 9: None, 10: None}
    inherited = {r["doc_id"]: (r["inherited"], r["inherited_from"]) for r in got if r["inherited"]}
    assert inherited == {6: ("MIT", "e"), 8: ("MIT", "e")}
    assert licenses.scan(d.limit(0), F.col("path")).count() == 0


def test_contaminated_rows_go_by_id_and_text(spark):
    item = "one two three four five six seven eight nine ten"
    data = [(None, f"x {item} y", "m"), (1, item, "m"), (1, "a clean text of the same id", "m"), (None, None, "m"), (2, "", "m")]
    d = spark.createDataFrame(data, "doc_id long, text string, mark string")
    out = decontaminate.drop_contaminated(d, spark.createDataFrame([(1, item), (2, None)], "item_id long, text string"))
    assert out.columns == d.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in out.collect() if r["text"]) == [("1", "a clean text of the same id")] and out.count() == 3


def test_the_shuffle_path_gives_the_same_rows(spark, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"some words before {' '.join(f'w{i % 7}x{k}' for k in range(i % 12))} and after") for i in range(60)] + [(None, None)], "doc_id long, text string")
    usual = sorted(str(r) for r in decontaminate.scan(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert sorted(str(r) for r in decontaminate.scan(docs, bench).collect()) == usual
