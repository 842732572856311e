"""Template decontamination: copies, re-parameterised questions, clean texts, brute force on copies."""

import collections
import random

import pytest

from factloom.llm import decontaminate
from factloom.llm.decontaminate import TemplateIndex, canonical, drop_contaminated, find_leaks

ITEM = "Yesterday Anna Lee bought 3 apples and 5 pears for 12 dollars, and then Anna gave 3 apples to the man who lives next door."


def leaks(text, item=ITEM):
    return TemplateIndex([(9, item)]).leaks(text)


def test_copies_and_new_parameters_leak():
    assert leaks(ITEM)[0][:2] == (9, 1.0)
    assert leaks("some words before " + ITEM + " and after it.")
    changed = ITEM.replace("Anna Lee", "Bob Stone").replace("Anna", "Bob").replace("3", "7").replace("5", "9").replace("12", "40").replace("dollars", "euros")
    assert leaks("Well, " + changed)[0][4] >= 4
    # One value of the item for two of the text: another question.
    assert not leaks(changed.replace("gave 7 apples", "gave 8 apples"))
    assert not leaks("Yesterday Anna Lee bought three new books about the man who lives next door.")


@pytest.mark.parametrize("text", [None, "", " ", "a", "x " * 20_000])
def test_clean_and_empty_texts(text):
    assert leaks(text) == []
    assert TemplateIndex([(1, text or "")]).leaks(ITEM) == []


def test_names_numbers_units():
    def kinds(text):
        codes, words, place = canonical(text)
        return len(codes)

    assert kinds("He met John Smith at 5 km") == kinds("He met Ann at 7 miles") == 6
    assert canonical("It is 5 km")[0].tolist() == canonical("it is 1,000.5 miles!")[0].tolist()
    assert canonical("a *** b | c")[0].tolist() == canonical("a b c")[0].tolist()


def test_matches_brute_force_on_copies(spark, monkeypatch):
    docs, items = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    grams = lambda t: (lambda w: {" ".join(w[k : k + 5]) for k in range(len(w) - 4)})(t.lower().split())
    index, total = collections.defaultdict(set), {}
    for r in items.collect():
        total[r.item_id] = len(grams(r.text))
        for g in grams(r.text):
            index[g].add(r.item_id)
    want = set()
    for r in docs.collect():
        met = collections.Counter(i for g in grams(r.text) for i in index.get(g, ()))
        want |= {(r.doc_id, i) for i, n in met.items() if n >= 0.8 * total[i]}
    got = find_leaks(docs.withColumn("item_id", docs.doc_id), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and want
    assert {(r.doc_id, r.item_id): tuple(r)[2:] for r in got} == {(r.doc_id, leak[0]): leak[1:] for r in docs.collect() for leak in TemplateIndex([(x.item_id, x.text) for x in items.collect()]).leaks(r.text)}
    monkeypatch.setattr(decontaminate, "MOST_BITS", 1 << 16)  # a table that is full
    monkeypatch.setattr(decontaminate, "ITEMS_A_ROW", 2)
    assert {(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()} == want
    kept = drop_contaminated(docs, items).collect()
    assert sorted(r.doc_id for r in kept) == sorted({r.doc_id for r in docs.collect()} - {i for i, _ in want})


def test_tables_with_nulls_and_none(spark):
    docs = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, ITEM), (2, None), (3, "")], "doc_id long, text string")
    items = spark.createDataFrame([(5, ITEM), (6, None), (7, ""), (None, ITEM)], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id or 0) for r in find_leaks(docs, items).collect())
    assert got == [(0, 0), (0, 5), (1, 0), (1, 0), (1, 5), (1, 5)]
    assert find_leaks(docs, items.limit(0)).count() == 0 and find_leaks(docs.limit(0), items).count() == 0
    assert drop_contaminated(docs, items).count() == 2


def test_first_window_recurs_in_the_item():
    item = "Tom has 5 apples and Ann has 7 apples and Bob has 9 apples and they eat them all today."
    for text in (item, "Some words before it. " + item + " And after it.", item + " " + item, "He said: " + item.replace("all today", "all today now")):
        assert leaks(text, item)[0][0] == 9, text
    assert leaks(item, item)[0][1] == 1.0
    # Half of the item and then all of it.
    assert leaks(" ".join(item.split()[:9]) + " " + item, item)[0][1] == 1.0
    assert not leaks(" ".join(item.split()[:9]), item)


def test_one_slot_does_not_void_a_copy():
    long = ITEM[:-1] + " and never asked for anything in return until the river rose again and all the fields were under water for a week."
    edited = long.replace("gave 3 apples", "gave 4 apples")
    assert leaks("Well, " + edited, long)[0][0] == 9
    # Other parameters everywhere, and two values for "3 apples": another question, however long.
    assert not leaks(edited.replace("Anna Lee", "Bob Stone").replace("Anna", "Bob").replace("bought 3", "bought 7").replace("5", "9").replace("12", "40").replace("man", "MAN").replace("asked", "begged").replace("river", "lake").replace("fields", "roads"), long)


def test_numbers_may_meet_or_part():
    item = "The baker sold 3 loaves in the morning and 4 rolls at noon and then he closed the shop for 3 hours to rest."
    assert leaks(item.replace("3", "5").replace("4", "5"), item)[0][4] == 4  # three numbers and a unit
    assert leaks(item.replace("3 loaves", "6 loaves").replace("3 hours", "2 hours"), item)
    assert not leaks("1 5 5 7 5 6 9 9 1 2", "1 2 3 4 5 6 7 8 9 10")


def test_units_are_slots_too():
    item = "A runner covers 5 km before noon and another 7 km after lunch and then rests for 2 hours under the old oak tree."
    assert leaks(item.replace("km", "miles").replace("5", "6").replace("hours", "minutes"), item)[0][4] == 6
    # The same unit twice in the item, two units in the text, and too few words of the item's own.
    assert not leaks(item.replace("5 km", "6 miles").replace("7 km", "8 feet").replace("2 hours", "3 days").replace("runner", "walker").replace("another", "maybe").replace("rests", "sleeps").replace("old oak", "big elm"), item)


def test_short_items_are_whole_documents():
    index = TemplateIndex([(1, "Paris."), (2, "Deep Blue"), (3, "42")])
    assert [leak[0] for leak in index.leaks("  paris ")] == [1] and [leak[0] for leak in index.leaks("deep blue!")] == [2]
    assert index.leaks("Paris is big") == index.leaks("43") == [] and [leak[0] for leak in index.leaks("42")] == [3]


def plain_changed(text, item):
    """Whether a text is the item with other numbers and names, one value for one: word by word."""
    bare = lambda s: [w.strip(".,!?") for w in s.split()]
    x, y, there, back = bare(item), bare(text), {}, {}
    if len(x) != len(y):
        return False
    for a, b in zip(x, y):
        slot = a.isdigit() and b.isdigit() or a[:1].isupper() and b[:1].isupper()
        if not slot and a != b or slot and (there.setdefault(a, b) != b or back.setdefault(b, a) != a):
            return False
    return True


def test_changed_parameters_match_brute_force(spark):
    rng = random.Random(2)
    words = "".join(" abcdefghijklmnopqrstuvwxyz").split() + "river market window garden basket letter".split()
    frame = [w for w in "when the boy called {0} sold {1} baskets to his friend {2} near the market he kept {3} of them and {0} gave {1} more to {2} before the evening came".split()]
    make = lambda a, b, c, d: " ".join(frame).format(a, b, c, d)
    names = "Ann Bob Carl Dora Emil Fritz".split()
    item = make("Ann", 31, "Bob", 47)
    rows = []
    for k in range(40):
        text = make(*(rng.choice(names), rng.randint(10, 30), rng.choice(names), rng.randint(50, 99)))
        if k % 3 == 1:  # one slot against the rest
            at = [i for i, w in enumerate(text.split()) if w[0].isupper()][-1]
            text = " ".join("Zoe" if i == at else w for i, w in enumerate(text.split()))
        if k % 3 == 2:
            text = " ".join(rng.choice(words) if i % 4 == 0 else w for i, w in enumerate(text.split()))
        rows.append((k, text))
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    want = {k for k, t in rows if plain_changed(t, item)}
    assert {r.doc_id for r in find_leaks(docs, items).collect()} == want and 5 < len(want) < 30


def test_scripts_without_spaces():
    """A Chinese or Japanese item is found inside a text, also with another number in it."""
    item, other = "小明有3个苹果，又买了5个，他现在一共有多少个苹果？", "東京の人口はどのくらいですか"
    index = TemplateIndex([(1, item), (2, other)])
    found = lambda text: [x[0] for x in index.leaks(text)]
    assert found(f"今天的题目是：{item}请回答。") == [1] and found(f"问：{item.replace('3', '8').replace('5', '9')}答") == [1]
    assert found(f"質問です。{other}。答えてください") == [2] and found("小明今天没有去学校，因为他的妈妈生病了。") == []
