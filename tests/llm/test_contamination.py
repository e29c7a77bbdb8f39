import numpy as np
from oracle import same

from cueweave.llm import contamination as C


def test_sql(spark):
    assert same(spark, "op10_contamination") > 0


def bench(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")


Q = "Mary buys 12 apples for 3 dollars each and then she gives 12 apples to Tom before the long walk home."


def test_reparameterised_and_inconsistent(spark):
    docs = [
        (1, "intro words " + Q + " end"),
        (2, Q.replace("Mary", "Ana").replace("12", "7,5").replace("Tom", "Édouard").replace("dollars", "euros")),
        (3, Q.replace("12 apples to", "13 apples to")),  # 12 goes with 12 and 13
        (4, "nothing like it at all but a few plain words in a row that go on for a while"),
        (5, Q.upper()),
        (6, Q.replace("apples", "pears").replace("walk", "ride")),
        (7, Q + " " + Q.replace("12", "5")),
    ]
    got = {(r.doc_id, r.item_id): r for r in C.matches(spark.createDataFrame(docs, "doc_id bigint, text string"), bench(spark, Q)).collect()}
    assert set(got) == {(1, 0), (2, 0), (5, 0), (7, 0)}
    assert got[5, 0].exact and got[5, 0].windows == 9  # word for word, in capitals
    assert got[1, 0].exact and not got[2, 0].exact and got[7, 0].exact
    assert got[1, 0].windows == 9 and got[7, 0].windows == 18


def test_short_items_and_all_capitals(spark):
    df = spark.createDataFrame([(1, "so the red fox ran home today"), (2, "A B C D E F G H I J K L M N"), (3, "so the red fox")], "doc_id bigint, text string")
    got = C.matches(df, bench(spark, "the red fox ran home", "A B C D E F G H I J K L M N", "the red fox", "Z Y X W V U T S R Q P O N M")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 0), (2, 1)}


def test_without_broadcast(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    b = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = sorted(map(tuple, C.matches(docs, b).collect()))
    monkeypatch.setattr(C, "BROADCAST_HASHES", 10)
    assert want and sorted(map(tuple, C.matches(docs, b).collect())) == want


def test_words_of_one_text():
    t = "In 2019 Éva ran 5 km, 10km -- (or 3.5 h) the km... $4"
    data = np.frombuffer(t.encode(), np.uint8)
    _, kind, _, tok = C.words(data, np.array([0, len(data)]), C.Powers(), C.unit_hashes())
    assert kind.tolist() == [3, 1, 3, 0, 1, 2, 4, 0, 1, 2, 0, 0, 1] and tok.tolist() == [0, 13]


def test_edges(spark):
    d = [(None, Q, 1), (1, None, 1), (2, "", 1), (3, Q, 2), (3, Q, 2), (4, "w " * 60000 + Q, None), (5, "clean", 3)]
    df = spark.createDataFrame(d, "doc_id bigint, text string, item_id int")
    b = spark.createDataFrame([(0, Q), (0, Q), (None, Q), (1, None), (2, "")], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in C.matches(df, b).collect()} == {(3, 0), (4, 0)}
    left = C.drop_contaminated(df, b)
    assert left.columns == df.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 5]
    assert C.matches(df.limit(0), b).count() == 0 and C.matches(df, b.limit(0)).count() == 0


def test_windows_equal_word_for_word_count_on_an_inconsistent_line(spark):
    plain = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(80))
    item = "first 12 of them " + plain + " and then 12 again with 7 or 8 more"
    docs = [(1, item.replace("then 12", "then 13")), (2, item.replace("7", "5").replace("8", "5")), (3, item)]
    got = {r.doc_id: r for r in C.matches(spark.createDataFrame(docs, "doc_id bigint, text string"), bench(spark, item)).collect()}
    w = item.split()
    at = lambda i: set(range(max(0, i - 12), min(i, len(w) - 13) + 1))  # windows over the word at i
    total = len(w) - 12
    second = len(w) - 7
    assert w[second] == "12" and set(got) == {1, 2, 3}
    assert got[1].windows == total - len(at(second)) and not got[1].exact
    assert got[2].windows == total - len(at(w.index("7")) | at(w.index("8"))) and not got[2].exact
    assert got[3].windows == total and got[3].exact


def test_copies_in_other_case_and_slot_rich_items(spark):
    items = ["What is 15 % of 80 dollars", "Alice buys 12 apples at 3 dollars each and 5 pears at 2 dollars", "Der Hund von Peter und die Katze von Maria sahen am Montag den Vogel im Garten", "yes no"]
    docs = [
        (1, "So: what is 20 % of 90 dollars?"),  # 'what' has no capital here: another template
        (2, "So: What is 20 % of 90 dollars?"),
        (3, "say Bob buys 7 apples at 4 dollars each and 6 pears at 9 dollars now"),
        (4, "say Bob buys 7 apples at 4 dollars each and 6 pears at 4 dollars now"),  # 4 goes with 3 and with 2
        (5, items[2].lower()),
        (6, "Der Hund von Anna und die Katze von Jonas sahen am Freitag den Vogel im Garten"),
        (7, "Der Tisch von Anna und die Lampe von Jonas standen am Freitag vor der Tür im Garten"),
        (8, "YES no!"),
        (9, "yes no maybe"),
        (10, "SO WHAT IS 15 % OF 80 DOLLARS NOW"),
    ]
    got = {(r.doc_id, r.item_id): r.exact for r in C.matches(spark.createDataFrame(docs, "doc_id bigint, text string"), bench(spark, *items)).collect()}
    assert got == {(2, 0): False, (3, 1): False, (5, 2): True, (6, 2): False, (8, 3): True, (10, 0): True}


def test_keys_of_other_types_and_scripts_without_spaces(spark):
    item = "这是一个关于苹果和梨的很长的问题答案是什么"
    docs = spark.createDataFrame([("uuid-a", "前面的话" + item + "后面"), ("b", "别的文章没有这个问题")], "doc_id string, text string")
    got = C.matches(docs, spark.createDataFrame([("q-1", item)], "item_id string, text string")).collect()
    assert [(r.doc_id, r.item_id, r.exact) for r in got] == [("uuid-a", "q-1", True)]
    left = C.drop_contaminated(docs, spark.createDataFrame([("q-1", item)], "item_id string, text string"))
    assert [r.doc_id for r in left.collect()] == ["b"]
