"""Coreference of names: titles in any form, initials, further words, bare mentions in the same text."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import edge  # noqa: E402

from folioflux.llm import pii  # noqa: E402


def test_names_stay_coreferent(spark):
    data = [(0, "Mr. Smith met Mr Smith. Mr John Smith's dog, John Smith and Smith left; SMITH Smithson Smith-Jones", "x"),
            (1, "Mr John F. Kennedy, Mr John Paul Smith and Frau von der Leyen; J. Kennedy, Leyen, John Paul Smith", "x"),
            (2, "Smith is bare here", "x"), (3, "Mrs Anna Smith and Mr Paul Smith", "x"), (4, "Mr Andrea Rossi, Ms Andrea Bianchi: Andrea Rossi, Andrea Bianchi", "x"),
            *[(10 + i, f"Herr {n} Meyer", "x") for i, n in enumerate("Ada Bo Cy Di Ed Flo Gus Hal Ida Jo Kit Lou Mo Ned Oz Pam Quin Ray Sue Ted Uma Val".split())]]
    rows = {r["doc_id"]: r for r in pii.replace_entities(edge.rows(spark, data), "k").collect()}
    new = {i: {e["mention"]: e["surrogate"] for e in r["entities"]} for i, r in rows.items()}
    family = new[0]["Smith"]
    assert new[0]["Mr. Smith"] == "Mr. " + family and new[0]["Mr Smith"] == "Mr " + family and new[0]["SMITH"] == family.upper()
    assert new[0]["Mr John Smith"] == "Mr " + new[0]["John Smith"] and new[0]["John Smith"].endswith(" " + family)
    assert rows[0]["text"].endswith(" Smithson Smith-Jones") and "'s dog, " in rows[0]["text"] and "John" not in rows[0]["text"]
    john, letter, kennedy = new[1]["Mr John F. Kennedy"].split()[1:]
    assert new[0]["John Smith"].split()[0] == john and letter[1] == "." and letter != "F." and new[1]["J. Kennedy"].endswith(". " + kennedy)
    assert new[1]["Mr John Paul Smith"] == "Mr " + new[1]["John Paul Smith"] and new[1]["John Paul Smith"].endswith(family)
    assert new[1]["Frau von der Leyen"] == "Frau von der " + new[1]["Leyen"]
    assert not any(w in rows[1]["text"] for w in ("John", "Paul ", "Kennedy", "Smith", "Leyen"))
    assert rows[2]["text"] == "Smith is bare here"
    assert new[3]["Mrs Anna Smith"].endswith(family) and new[3]["Mr Paul Smith"].endswith(family)
    assert new[4]["Mr Andrea Rossi"] == "Mr " + new[4]["Andrea Rossi"] and new[4]["Ms Andrea Bianchi"] == "Ms " + new[4]["Andrea Bianchi"]
    assert len({r["text"] for i, r in rows.items() if i >= 10}) == 22


SHAPES = {"given names": "Mr John Smith " + "John " * 20_000, "labels": "x@a" + ".bb" * 30_000, "no sign": "a" * 300_000, "signs": "a@" * 50_000, "hyphens": "Mr A" + "a-b" * 30_000,
          "initials": "Mr John Smith " + "J. " * 20_000, "digits": "123-" * 30_000, "particles": "Mr John Smith " + "von " * 20_000, "dots": "x@" + "." * 100_000, "titles": "Mr " * 30_000}


def test_long_texts_of_any_shape_end(spark):
    """Runs that a pattern's loops could walk with a stack frame a turn, or again from each of their places."""
    rows = pii.replace_entities(edge.rows(spark, [(i, t, "x") for i, t in enumerate(SHAPES.values())]), "k").collect()
    assert len(rows) == len(SHAPES) and "Smith" not in next(r["text"] for r in rows if r["doc_id"] == 0)


def luhn(digits):
    return sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, digits))) % 10 == 0


def test_card_numbers_keep_their_check_digit(spark):
    cards = ["4111111111111111", "5500-0000-0000-0004", "4012 8888 8888 1881", "4111111111111112"]
    out = pii.replace_entities(edge.rows(spark, [(i, c, "x") for i, c in enumerate(cards)]), "k").collect()
    new = {r["doc_id"]: "".join(c for c in r["text"] if c.isdigit()) for r in out}
    assert all(luhn(new[i]) for i in (0, 1, 2)) and all(len(new[i]) == 16 for i in new) and new[0] != cards[0]


def test_a_full_space_of_numbers_is_lengthened(spark):
    """More than half of the numbers of a form: no two share a surrogate, none is one of them."""
    numbers = [f"+1 55 {a:02d}" for a in range(10, 90)] + [f"+1 56 {a:02d}" for a in range(10, 90)]
    out = pii.replace_entities(edge.rows(spark, [(i, n, "x") for i, n in enumerate(numbers)]), "k").collect()
    texts = {r["text"] for r in out}
    assert len(texts) == len(numbers) and not texts & set(numbers)
