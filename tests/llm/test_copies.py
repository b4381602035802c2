"""Exact dedup: filter by count, ids of any type or none, ties, long and clashing input."""

from test_llm_operators import table

from ponderlake.llm import exact_dedup


def test_filter_follows_the_number_of_rows():
    for n in (1, 1000, 10**6, 10**8):
        bits = exact_dedup.filter_size(n)
        assert n / 2**bits <= 1 / exact_dedup.BITS_PER_ROW and (bits == 15 or n / 2 ** (bits - 1) > 1 / exact_dedup.BITS_PER_ROW)
    assert exact_dedup.filter_size(10**12) == exact_dedup.MOST_BITS


def test_few_unique_rows_look_repeated(spark):
    """The second filter holds hardly more than what is repeated."""
    n = 20_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    rows = docs.select("doc_id", exact_dedup.digest(docs["text"]).alias("d"))
    mask = (1 << exact_dedup.filter_size(n)) - 1
    hit = rows.selectExpr(f"cast(conv(substring(d, 1, 15), 16, 10) AS long) & {mask} AS bit").groupBy("bit").count().where("count > 1")
    assert hit.selectExpr("sum(count)").first()[0] < n / 14
    assert exact_dedup.exact_dedup(docs).where("kept AND keep_id = doc_id AND group_size = 1").count() == n


def test_null_ids_stay_only_if_no_row_has_one(spark):
    df = spark.createDataFrame([(None, "a  b"), (1, "ab"), (2, "a b"), (None, "c"), (None, "c "), (3, None), (4, " ")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect()), key=repr)
    want = [(None, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True), (None, None, 2, True), (None, None, 2, True), (3, 4, 2, False), (4, 4, 2, True)]
    assert got == sorted(want, key=repr)
    assert sorted((r.doc_id or 0, r.text) for r in exact_dedup.distinct(df).collect()) == [(0, "c"), (0, "c "), (2, "a b"), (4, " ")]


def test_ids_of_other_types_and_one_id_with_two_texts(spark):
    df = spark.createDataFrame([("b", "x", 1), ("a", "x", 2), ("c", "y", 3), ("b", "z", 4)], "doc_id string, text string, keep_id int")
    got = table(exact_dedup.exact_dedup(df))
    assert {(r.keep_id, r.kept) for r in got["b"]} == {("a", False), ("b", True)} and got["a"][0].group_size == 2
    assert sorted(r.keep_id for r in exact_dedup.distinct(df).collect()) == [2, 3, 4]


def test_long_texts_and_many_copies(spark):
    long = "word " * 200_000
    docs = spark.createDataFrame([(1, long), (2, long.strip()), (3, long + "x")], "doc_id long, text string")
    docs = docs.unionByName(spark.range(10, 3010).selectExpr("id AS doc_id", "'copy' AS text"))
    got = table(exact_dedup.exact_dedup(docs))
    assert (got[2][0].keep_id, got[3][0].keep_id, got[2999][0].keep_id, got[10][0].group_size) == (1, 3, 10, 3000)
