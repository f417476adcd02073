import random

import numpy as np
import pyarrow as pa

from kinspan.llm import decontam
from kinspan.llm.decontam import KINDS, contaminated, drop_contaminated, templates
from kinspan.llm.words import as_bytes


def filler(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))


QUESTION = "a train leaves Boston at 9:30 with 40 passengers and travels 120 miles to Albany where 15 passengers leave before the train returns to Boston empty"
OTHER = "a train leaves Denver at 7:15 with 62 passengers and travels 300 miles to Pueblo where 22 passengers leave before the train returns to Denver empty"
BROKEN = "a train leaves Denver at 7:15 with 62 passengers and travels 300 miles to Pueblo where 22 passengers leave before the train returns to Tulsa empty"


def test_kinds_of_words():
    text = 'We met Anna, on "5,000" km roads. Paris has 3 kg of +4.5% and 7 days\nThe end'
    data, offsets = as_bytes(pa.array([text]))
    words, starts, ends, _, kinds = templates(data, offsets)
    found = [(data[s:e].tobytes().decode(), KINDS[k]) for s, e, k in zip(starts, ends, kinds, strict=True)]
    assert [f for f in found if f[1]] == [("Anna", "name"), ("5,000", "number"), ("km", "unit"), ("3", "number"), ("kg", "unit"), ("4.5%", "number"), ("7", "number"), ("days", "unit")] or ("+4.5%", "number") in found
    assert len(words.starts) == len(kinds)


def test_documents_that_hold_items(spark):
    r = random.Random(2)
    benchmark = spark.createDataFrame([(1, QUESTION), (2, filler(r, 30)), (3, "short item"), (4, None), (5, "")], "item_id long, text string")
    plain = benchmark.where("item_id = 2").first().text
    rows = [(10, filler(r, 50) + " " + QUESTION + " " + filler(r, 20)), (11, filler(r, 9) + " " + OTHER), (12, filler(r, 9) + " " + BROKEN), (13, filler(r, 400)), (14, plain.upper() + "."), (15, "a b short item c"), (16, None), (17, ""), (10, filler(r, 5)), (None, QUESTION), (18, " ".join(plain.split()[:9]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as hash", "3 as item_id")
    found = {(x.doc_id, x.item_id): x for x in contaminated(docs, benchmark).collect()}
    assert set(found) == {(10, 1), (11, 1), (14, 2), (15, 3)}
    assert found[10, 1].same_slots and not found[11, 1].same_slots and found[14, 2].coverage == 1
    kept = [x.doc_id for x in drop_contaminated(docs, benchmark).collect()]
    assert sorted(kept) == [12, 13, 16, 17, 18]  # the row without id holds an item too
    assert contaminated(docs.limit(0), benchmark).count() == 0 and contaminated(docs, benchmark.limit(0)).count() == 0


def test_without_filter_the_result_is_the_same(spark, monkeypatch):
    r = random.Random(3)
    items = [(i, filler(r, r.randint(3, 40))) for i in range(20)]
    docs = [(i, filler(r, 30) + " " + items[i % 20][1] + " " + filler(r, 30) if i % 3 else filler(r, 80)) for i in range(60)]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(contaminated(*tables).collect())
    monkeypatch.setattr(decontam, "MAX_FILTER", 0)
    assert sorted(contaminated(*tables).collect()) == one
    assert {(x.doc_id, x.item_id) for x in one} == {(i, i % 20) for i in range(60) if i % 3}
    assert np.isclose([x.coverage for x in one], 1).all()


def test_copies_in_another_case(spark):
    items = [
        (1, "l'été dernier, ma sœur a été élue à l'évêché après Éléonore Château; où êtes-vous allés, près de l'hôtel à Évian où Zoë dînait"),
        (2, "am Straßenrand größerer Städte überqueren Füchse nachts häufig Äcker und Höfe übermütiger Bäcker"),
        (3, "οι φίλοι μας ήρθαν χθες από τους Δελφούς και είδαν όλους τους ναούς της παλιάς πόλης"),
    ]
    docs = [(10 * i + k, "dans ce texte " + change(text) + " fin de cela") for i, text in items for k, change in enumerate((str.upper, str.title, str.lower, str))]
    found = {(x.doc_id, x.item_id): x for x in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(found) == {(10 * i + k, i) for i, _ in items for k in range(4)}
    assert all(x.coverage == 1 and x.same_slots for x in found.values())


def test_names_by_code_points():
    data, offsets = as_bytes(pa.array(["von Élan ÉONLEEAU ÉÉ Éa Ωμέγα ΩΜΕΓΑ Журнал ЖУРНАЛ O'Neil USA-made éa 𐐀𐐨 Ab2 AB2"]))
    _, starts, ends, _, kinds = templates(data, offsets)
    assert [data[s:e].tobytes().decode() for s, e, k in zip(starts, ends, kinds, strict=True) if KINDS[k] == "name"] == ["Élan", "Éa", "Ωμέγα", "Журнал", "O'Neil", "USA-made", "𐐀𐐨", "Ab2"]


def test_names_that_begin_sentences_and_windows_of_placeholders(spark):
    tom = "Tom has 5 apples. Tom gives 2 to Mary. Tom then buys 4 more apples. Tom eats 1 of them. How many are left?"
    sara = tom.replace("Tom", "Sara").replace("Mary", "Bill").replace("5", "7").replace("4", "9")
    broken = sara.replace("Sara eats", "Bill eats").replace("Sara then", "Zoe then").replace("Sara gives", "Ann gives")
    rich = "mix 5 kg 3 g 20 ml 7 Smith 9 Jones 4 cm 8 days 6 weeks 11 Baker 12 hours"
    docs = [(1, "Look at this one. " + sara), (2, broken), (3, "so we go and " + rich.upper()), (4, "some other words that hold nothing of the items")]
    found = {(x.doc_id, x.item_id): x for x in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, tom), (2, rich)], "item_id long, text string")).collect()}
    assert set(found) == {(1, 1), (3, 2)}
    # One window of 17 has fewer than half plain words in the reading with names.
    assert found[1, 1].n_matched == 16 and found[1, 1].n_windows == 17 and not found[1, 1].same_slots and found[3, 2].coverage == 1


def test_slots_agree_along_a_whole_passage(spark):
    item = "the shop sold 40 red apples on monday and then it sold another batch of 40 red apples to a baker on the next day"
    words = item.replace("40", "41").split()
    shifted = words[:12] + ["also"] + words[12:]
    wrong = [*shifted]
    wrong[max(i for i, w in enumerate(wrong) if w == "41")] = "77"
    docs = [(1, " ".join(shifted)), (2, " ".join(wrong)), (3, " ".join(words)), (4, " ".join(words[:3] + words[4:])), (5, item + " . and more of it : " + " ".join(words))]
    found = {x.doc_id: x for x in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(found) == {1, 3, 4, 5} and found[3].coverage == 1 and found[5].same_slots and not found[1].same_slots


def test_templates_against_brute_force(spark):
    """Items with numbers and names in fresh or broken versions, by their own words."""
    r = random.Random(11)
    items, docs, truth = [], [], set()
    for i in range(30):
        words = filler(r, 26).split()
        for k in (3, 9, 15, 21):
            words[k] = "#" if k % 2 else "@"
        fill = lambda n, name: [str(n) if w == "#" else name if w == "@" else w for w in words]  # noqa: B023, E731
        items.append((i, " ".join(fill(r.randint(10, 99), "Anna"))))
        docs.append((3 * i, filler(r, 12) + " " + " ".join(fill(r.randint(100, 999), "Otto")) + " " + filler(r, 9)))
        truth.add((3 * i, i))
        broken = fill(7, "Otto")
        for n, k in enumerate(j for j, w in enumerate(words) if w == "#"):
            broken[k] = str(1000 + n)
        docs.append((3 * i + 1, filler(r, 12) + " " + " ".join(broken) + " " + filler(r, 9)))
        docs.append((3 * i + 2, filler(r, 60)))
    found = {(x.doc_id, x.item_id) for x in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == truth


def test_dropping_keeps_names_and_rows(spark):
    docs = spark.createDataFrame([(1, "clean"), (1, "clean"), (None, None), (None, QUESTION), (2, "x " * 400_000)], "doc_id long, text string").selectExpr("*", "'d' as document", "'h' as hash")
    out = drop_contaminated(docs, spark.createDataFrame([(1, QUESTION)], "item_id long, text string"))
    assert out.columns == docs.columns and sorted(str(x.doc_id) for x in out.collect()) == ["1", "1", "2", "None"]


def test_words_between_any_white_space(spark):
    r = random.Random(13)
    item = filler(r, 30)
    blanks = ["\u00a0", "\u2003", "\u3000", "\u0085", "\u1680", "\u202f", "\u205f", "\t"]
    words = item.split()
    other = words[0] + "".join(r.choice([" ", *blanks]) + w for w in words[1:])
    docs = spark.createDataFrame([(1, "so " + other), (2, filler(r, 60))], "doc_id long, text string")
    (found,) = contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert found.doc_id == 1 and found.coverage == 1


def test_one_name_that_stands_for_several_refuses_the_passage(spark):
    item = "Tom has 12 marbles in a small red box. Tom then buys 8 more marbles from the old shop near the river. Tom wants to know how many marbles there are in 3 boxes of this kind"
    fresh = item.replace("Tom", "Sara").replace("12", "15").replace("8", "9").replace("3", "4")
    several = fresh.replace("Sara then", "Bob then").replace("Sara wants", "Carl wants")
    docs = [(1, fresh), (2, several), (3, item.replace("Tom", "The boy", 1).replace("12", "14"))]
    found = {x.doc_id: x for x in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert 1 in found and found[1].coverage > 0.9 and 2 not in found
