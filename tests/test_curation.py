"""Curation, extraction and incremental jobs on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from recspark import schemas
from recspark.functions import text as X
from recspark.operators import caps, enrich, flags, sentiment, shelves
from recspark.sources import html, merge, sinks, tables, xml

SHELF = "STRUCT<shelve: STRING, count: BIGINT>"
NESTED = (
    "gid BIGINT, reviews_retrieved BOOLEAN, shelves_reviews_retrieved BOOLEAN, "
    f"list_reviews ARRAY<STRUCT<gid: BIGINT, rating: BIGINT, book: STRUCT<gid: BIGINT, title: STRING, list_shelves: ARRAY<{SHELF}>>>>"
)


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_scalar_functions(spark):
    lit = F.lit
    assert one(spark, X.poly_hash(lit("abc"))) == 283437412
    assert one(spark, X.ascii_fold(lit("aéèb"))) == "a b"
    assert one(spark, X.ascii_fold(lit(None).cast("string"))) is None
    assert one(spark, X.date_from_parts(lit(2011), lit(None), lit(None))) == dt.datetime(2011, 1, 1)
    assert one(spark, X.date_from_parts(lit(2011), lit(2), lit(31))) is None
    assert one(spark, X.date_from_parts(lit(None), lit(5), lit(1))) is None
    assert one(spark, X.parse_review_date(lit("  Mar 16, 2011"))) == dt.datetime(2011, 3, 16)
    assert one(spark, X.parse_review_date(lit("unknown"))) is None
    assert one(spark, X.flip_name(lit("Last, First"))) == "First Last"
    assert one(spark, X.flip_name(lit("Mono"))) == "Mono"
    assert one(spark, X.plain_int(lit(" 1,234,567"))) == 1234567
    assert one(spark, X.first_number(lit("/book/show/42-x7"))) == 42
    assert one(spark, X.first_number(lit("none"))) is None
    assert one(spark, X.first_token(lit("[Ann Lee"))) == "Ann"
    assert one(spark, X.percent(lit(0.256))) == 26
    assert one(spark, X.safe_ratio(lit(1), lit(0))) == 0.0


@pytest.mark.parametrize("ratings,want", [([5, 4, 3, 2, 1], [5, 4, 3]), ([2, 1], [2, 1]), ([1, 5, 5], [5, 5])])
def test_caps(spark, ratings, want):
    rows = [(1, i, r) for i, r in enumerate(ratings)]
    long = spark.createDataFrame(rows, "user_id bigint, review_id bigint, rating bigint")
    assert [r.rating for r in caps.cap_reviews(long).orderBy("pos").collect()] == want
    nested = [(1, True, False, [(i, r, (9, "t", None)) for i, r in enumerate(ratings)])]
    users = caps.cap_nested_reviews(spark.createDataFrame(nested, NESTED)).first()
    assert [r.rating for r in users.list_reviews] == want
    assert users.reviews_count == len(want) and users.reviews_filtered
    assert "list_shelves" not in users.list_reviews[0].book.asDict()


def test_cap_limits_and_null_list(spark):
    nested = [(1, True, False, [(i, 5, (9, "é", None)) for i in range(7)]), (2, True, False, None)]
    users = caps.cap_nested_reviews(spark.createDataFrame(nested, NESTED), limit=4).orderBy("gid").collect()
    assert [r.gid for r in users[0].list_reviews] == [0, 1, 2, 3]
    assert users[0].list_reviews[0].book.title == " "
    assert users[1].list_reviews is None and users[1].reviews_filtered


def test_enrich_nested(spark):
    s = [("s", 1)]
    users = [
        (1, True, False, [(1, 5, (10, "a", None)), (2, 4, (11, "b", []))]),  # one resolves, one does not
        (2, True, False, [(3, 5, (10, "a", None)), (4, 5, (12, "c", s))]),
        (3, True, False, None),
        (4, True, True, [(5, 5, (10, "a", None))]),  # done already
        (5, False, False, [(6, 5, (10, "a", None))]),  # reviews not retrieved
        (6, True, False, []),
    ]
    books = spark.createDataFrame([(10, [("x", 2)]), (11, None)], f"gid bigint, list_shelves array<{SHELF}>")
    df = spark.createDataFrame(users, NESTED)

    def run(mode):
        rows = enrich.enrich_nested_users(df, books, mode).collect()
        return {
            r.gid: (
                r.reviews_retrieved,
                r.shelves_reviews_retrieved,
                None if r.list_reviews is None else [(x.gid, [y.shelve for y in x.book.list_shelves or []]) for x in r.list_reviews],
            )
            for r in rows
        }

    retry, drop = run("retry"), run("drop")
    assert retry[1] == (True, False, [(1, ["x"]), (2, [])])
    assert drop[1] == (True, True, [(1, ["x"])])
    assert retry[2] == drop[2] == (True, True, [(3, ["x"]), (4, ["s"])])
    assert retry[3] == drop[3] == (False, False, None)
    assert retry[4] == drop[4] == (True, True, [(5, [])])
    assert retry[5] == drop[5] == (False, False, [(6, [])])
    assert retry[6] == (False, False, [])


def test_flags(spark):
    books = spark.createDataFrame(
        [(1, True, None), (2, False, [("a", 1)]), (3, True, []), (4, None, [("a", 1)])],
        f"gid bigint, shelves_retrieved boolean, list_shelves array<{SHELF}>",
    )
    both = flags.repair_flag(books, "shelves_retrieved", "list_shelves").orderBy("gid")
    assert [r.shelves_retrieved for r in both.collect()] == [False, True, False, True]
    clear = flags.repair_flag(books, "shelves_retrieved", "list_shelves", "clear").orderBy("gid")
    assert [r.shelves_retrieved for r in clear.collect()][:3] == [False, False, False]


def test_insert_and_update(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "gid bigint, title string")
    new = spark.createDataFrame([(2, "x"), (3, "d"), (3, "c")], "gid bigint, title string")
    rows = {r.gid: (r.title, r.existed) for r in merge.insert_if_absent(base, new, ["gid"], "title").collect()}
    assert rows == {1: ("a", True), 2: ("b", True), 3: ("c", False)}
    upd = spark.createDataFrame([(2, None)], "gid bigint, title string")
    rows = {r.gid: r.title for r in merge.merge_update(base, upd, ["gid"], ["title"]).collect()}
    assert rows == {1: "a", 2: None}


def test_csv_inputs(spark, tmp_path):
    (tmp_path / "r.csv").write_text("iduser,rating,idproduct,idcategory,parent\n1,5.0,100,7,NULL\n1,3.0,101,7,2\n2,4.0,100,7,2\n")
    from recspark.plans.fwum import ratings_to_interactions

    rows = ratings_to_interactions(tables.read_ratings_csv(spark, str(tmp_path / "r.csv"))).collect()
    assert sorted(map(tuple, rows)) == [(1, 100, 7), (2, 100, 2)]
    (tmp_path / "t.csv").write_text("1,2,10,4.0\n3,2,10,4.0\n1,3,11,2.5\n")
    edges, reviews = tables.read_trust_csv(spark, str(tmp_path / "t.csv"))
    assert sorted(map(tuple, edges.collect())) == [(1, 2), (1, 3), (3, 2)]
    from recspark.operators.trust_graph import dedupe_reviews

    assert sorted(map(tuple, dedupe_reviews(reviews, "source").collect())) == [(2, 10, 4.0), (3, 11, 2.5)]


def test_nested_interactions_scan(spark, tmp_path):
    from recspark.plans.fwum import explode_interactions

    df = spark.createDataFrame([(1, [(10, [7, 7, 8]), (11, [])])], schemas.INTERACTIONS_NESTED)
    df.write.parquet(str(tmp_path / "i"))
    rows = explode_interactions(tables.read_interactions(spark, str(tmp_path / "i"))).collect()
    assert sorted(map(tuple, rows)) == [(1, 10, 7), (1, 10, 7), (1, 10, 8)]


@pytest.mark.parametrize("name", ["BOOKS", "AUTHORS", "REVIEWS", "SHELVES", "USERS", "RECOMMENDATION"])
def test_table_schemas_parse(spark, name):
    assert spark.createDataFrame([], getattr(schemas, name)).isEmpty()


def test_sinks(spark, tmp_path):
    recs = spark.createDataFrame([(1, 1, 10, 5), (1, 2, 11, 4)], "user_id bigint, rank bigint, item_id bigint, score bigint")
    run = sinks.run_id(20, 40)
    for _ in range(2):
        sinks.write_recommendations(sinks.tag_run(recs, run), str(tmp_path / "r"), files=1)
    back = spark.read.parquet(str(tmp_path / "r"))
    assert back.count() == 2 and back.select("run_id").distinct().count() == 1
    sinks.write_recommendations(recs, str(tmp_path / "c"), files=1, fmt="csv")
    assert spark.read.csv(str(tmp_path / "c")).count() == 2


def test_shelf_table_chunks(spark):
    books = spark.createDataFrame([(i, [("hot", 1)] + ([("odd", 1)] if i % 2 else [])) for i in range(100)], f"gid bigint, list_shelves array<{SHELF}>")
    rows = shelves.shelf_table(books, chunk=10).collect()
    hot = [r for r in rows if r.shelve == "hot"]
    assert len(hot) > 1 and sorted(b for r in hot for b in r.list_book) == list(range(100))
    assert all(len(r.list_book) < 40 for r in rows)


BOOK = """<response><book><id>5</id><title>Café</title><isbn/><publication_year>2011</publication_year>
<average_rating>4.1</average_rating><ratings_count>7</ratings_count><popular_shelves>{shelves}</popular_shelves>
<authors><author><id>1</id><name>A</name></author></authors></book></response>"""


def test_xml_shelves_one_many_none(spark):
    texts = [BOOK.format(shelves=s) for s in ('<shelf name="x" count="3"/>', '<shelf name="x" count="3"/><shelf name="y" count="1"/>', "")]
    df = spark.createDataFrame([(t,) for t in texts], "xml string").coalesce(1)
    rows = xml.parse_book_xml(df).collect()
    assert sorted(len(r.list_shelves) for r in rows) == [0, 1, 2]
    assert rows[0].title == "Caf " and rows[0].author.gid == 1 and rows[0].publication_date == dt.datetime(2011, 1, 1)
    assert rows[0].similar_books is None and rows[0].small_book is False


PAGE = """<table id="books"><tbody><tr id="review_9"><td class="title"><div class="value"><a href="/book/show/3.T">  A T</a></div></td>
<td class="field author"><div class="value"><a href="/a/8">Last, First</a></div></td>
<td class="field isbn"><div class="value"></div></td><td class="field isbn13"><div class="value"></div></td>
<td class="field avg_rating"><div class="value"> 3.5</div></td><td class="field num_ratings"><div class="value">1,000</div></td>
<td class="field date_added"><div class="value"><span>Mar 16, 2011</span></div></td>
<td class="field rating"><div class="value">{rating}</div></td><td class="review">{review}</td></tr></tbody></table>"""
STARS = '<span class="p10"></span>'


@pytest.mark.parametrize(
    "rating,review,want",
    [
        (STARS * 3, "<span>a</span>", (3, "a")),
        (STARS * 2, "<span>a</span>", None),
        ("", "<span>a</span>", None),
        ('<div class="stars" data-rating="4"></div>', "<span>a</span><span>b <i>c</i></span>", (4, "b c")),
        ('<a class="staticStars">' + STARS * 5 + "</a>", "none", (5, None)),
    ],
)
def test_html_reviews(spark, rating, review, want):
    df = spark.createDataFrame([(1, PAGE.format(rating=rating, review=review)), (2, "<p>no table</p>"), (3, None)], "page_id bigint, html string")
    rows = html.extract_review_rows(df).collect()
    assert [(r.rating, r.text) for r in rows] == ([] if want is None else [want])
    if rows:
        r = rows[0]
        assert (r.review_gid, r.book_gid, r.author_gid, r.author_name, r.ratings_count) == (9, 3, 8, "First Last", 1000)
        assert r.title == "A T" and r.date_added == dt.datetime(2011, 3, 16)


def test_html_labelled_cells(spark):
    cell = lambda name, value: f'<td class="field {name}"><label>{name} 99</label><div class="value">{value}</div></td>'
    page = '<table id="books"><tbody><tr id="review_9">' + "".join([
        cell("title", '<a href="/book/show/3.T">A <b>T</b></a> <div>x</div>'), '<td class="title"><div class="value">second</div></td>',
        cell("author", '<a href="/a/8">Last, First</a><span>*</span><a href="/a/9">Other</a>'), cell("isbn", "0123"), cell("isbn13", "978"),
        cell("avg_rating", "3.5"), cell("num_ratings", "1,000"), cell("date_added", "<span>Mar 16, 2011</span>"),
        cell("rating", STARS * 4), cell("review", "<span>short</span><span>the whole</span>"),
    ]) + "</tr></tbody></table>"
    r = html.extract_review_rows(spark.createDataFrame([(1, page)], "page_id bigint, html string")).first()
    assert (r.review_gid, r.book_gid, r.title, r.author_gid, r.author_name) == (9, 3, "A T x", 8, "First Last")
    assert (r.isbn, r.isbn13, r.average_rating, r.ratings_count, r.rating, r.text) == ("0123", "978", 3.5, 1000, 4, "the whole")
    assert r.date_added == dt.datetime(2011, 3, 16)


def test_sentences_are_all_kept(spark):
    docs = spark.createDataFrame([(1, "Good day. 42! Good, bad? Odd"), (2, ""), (3, None)], "doc_id bigint, text string")
    lexicon = spark.createDataFrame([("good", 1.0, 0.5), ("bad", -0.5, 1.0)], "word string, polarity double, subjectivity double")
    scored = sentiment.sentence_sentiment(docs, lexicon)
    rows = [tuple(r) for r in scored.orderBy("pos").collect()]
    assert rows == [(1, 0, "Good day", 2, 1.0, 0.5), (1, 1, "42", 0, 0.0, 0.0), (1, 2, "Good, bad", 2, 0.25, 0.75), (1, 3, "Odd", 1, 0.0, 0.0)]
    blobs = {r.doc_id: (r.instantiated, None if r.sentences is None else [tuple(s) for s in r.sentences]) for r in sentiment.review_textblob(docs, scored).collect()}
    assert blobs == {1: (True, [r[2:3] + r[4:] for r in rows]), 2: (True, []), 3: (False, None)}


def test_runs_are_seen_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "runs")
    table = lambda *ids: spark.createDataFrame([(i,) for i in ids], "user_id bigint")
    broken = table(1).withColumn("x", F.raise_error(F.lit("lost")).cast("int"))
    sinks.publish_run(spark, root, "a", {"recs": table(1, 2), "metrics": table(1)}, n=3)
    for _ in range(2):  # breaks between its two tables
        with pytest.raises(Exception, match="lost"):
            sinks.publish_run(spark, root, "b", {"recs": table(5), "metrics": broken}, n=4)
    with pytest.raises(Exception, match="lost"):
        sinks.publish_run(spark, root, "a", {"recs": table(9), "metrics": broken}, n=5)
    seen = lambda: {r.run_id: (r.params["n"], r.counts) for r in sinks.published_runs(spark, root).collect()}
    assert seen() == {"a": ("3", {"recs": 2, "metrics": 1})}
    with pytest.raises(LookupError):
        sinks.read_run(spark, root, "b", "recs")
    sinks.publish_run(spark, root, "b", {"recs": table(5), "metrics": table()}, n=4)
    sinks.publish_run(spark, root, "a", {"recs": table(9), "metrics": table(9)}, n=5)
    assert seen() == {"a": ("5", {"recs": 1, "metrics": 1}), "b": ("4", {"recs": 1, "metrics": 0})}
    assert [tuple(r) for r in sinks.read_run(spark, root, "a", "recs").collect()] == [(9, "a")]
    assert sinks.read_run(spark, root, "b", "metrics").count() == 0
