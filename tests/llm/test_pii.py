"""Distinctness, coreference and formats of surrogates, against all pairs."""

import itertools
import re

from quarry.llm import pii

KEY = b"a key for tests"
TEXT = [
    (1, "Mr. Muller met Mr. Müller, Mr. Mûller and Mr. Mùller; Dr. Smith and Wei Zhang wrote to Fatima Hassan."),
    (2, "Call (377) 555-0271 or 377-555-0271 or +1 377 555 0271. Card 4111 1111 1111 1111, GB82 WEST 1234 5698 7654 32."),
    (3, "From 10.0.0.1 and 10.0.0.2 to 8.8.8.8 by ann.lee@mail.example.com"),
    (4, None),
    (5, ""),
    (2, "Mr. Müller again"),
]


def run(spark, **more):
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in TEXT], "doc_id long, text string, done string, row string").repartition(3)
    return pii.pseudonymise(d, KEY, info_col="entities", **more)


def test_surrogates_stay_distinct_and_coreferent(spark):
    rows = run(spark)
    assert rows.columns == ["doc_id", "text", "done", "row", "entities"]
    got = {(r["doc_id"], len(r["text"] or "")): r for r in rows.collect()}
    assert len(got) == len(TEXT) and got[4, 0]["text"] is None and got[5, 0]["text"] == ""
    one = next(r for r in got.values() if r["doc_id"] == 1)
    names = [x["surrogate"] for x in one["entities"]]
    assert len(names) == 7 and len(set(names)) == 7
    again = next(r for r in got.values() if r["doc_id"] == 2 and len(r["entities"]) == 1)
    assert again["entities"][0]["surrogate"] == names[1] != "Mr. Müller"
    two = next(r for r in got.values() if r["doc_id"] == 2 and len(r["entities"]) > 1)
    phones = [x["surrogate"] for x in two["entities"] if x["kind"] == "phone"]
    assert len({re.sub(r"\D", "", p)[-10:] for p in phones}) == 1 and phones[2].startswith("+1 ")
    card = next(x["surrogate"] for x in two["entities"] if x["kind"] == "card")
    assert pii._luhn(card.replace(" ", "")) == 0 and card != "4111 1111 1111 1111"
    iban = next(x["surrogate"] for x in two["entities"] if x["kind"] == "iban").replace(" ", "")
    assert iban[2:4] == pii._iban_check(iban[:2], iban[4:])
    three = next(r for r in got.values() if r["doc_id"] == 3)
    ips = [x["surrogate"] for x in three["entities"] if x["kind"] == "ip"]
    assert ips[0].startswith("10.") and ips[1].startswith("10.") and len(set(ips)) == 3 and not pii._network(int.from_bytes(bytes(map(int, ips[2].split("."))), "big"))


def test_collisions_are_rekeyed_until_none_is_left(spark, monkeypatch):
    """A map that sends many names to one: the check parts them, by closure and by join, with the same result."""
    plain = pii.letters

    def poor(key, kind, text):
        return plain(key, kind, text) if "#" in kind and not kind.startswith("name#1|") else "Xx" if kind.startswith("name") else plain(key, kind, text)

    monkeypatch.setattr(pii, "letters", poor)
    few, many = (sorted(str(r) for r in run(spark, travel=n).collect()) for n in (100, 0))
    assert few == many
    names = {x["surrogate"] for r in run(spark).collect() for x in r["entities"] if x["kind"] == "name"}
    assert len(names) == 7


def test_maps_have_no_two_equal_images():
    seen = {pii.surrogate(KEY, "name", f"Mr. {a}{b}{c}") for a, b, c in itertools.product("ABÄÁ", "aeäö", "lnñ")}
    assert len(seen) == 48
    assert len({pii.address(KEY, "ip", n) for n in range(0x0A000000, 0x0A000400)}) == 1024
    assert len({pii.card(KEY, "card", f"{n:016d}") for n in range(500)}) == 500


def test_key_comes_from_configuration(spark):
    random_key = pii.configured_key(spark)
    assert len(random_key) == 32 and pii.configured_key(spark) == random_key
    spark.conf.set("spark.quarry.pii.key", "mine")
    try:
        assert pii.configured_key(spark) == b"mine"
    finally:
        spark.conf.unset("spark.quarry.pii.key")
