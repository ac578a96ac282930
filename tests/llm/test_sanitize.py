"""Spans of personal data and of disclosing terms against plain Python."""

import hashlib
import math
import random

import regex
from pyspark.sql import functions as F

from oracle import compare, connect
from recspark.llm import catalog, sanitize

SCHEMA = "doc_id long, text string, base int, spans string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = regex.compile(r"[\p{L}\p{N}]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def digits(m):
    return [int(c) for c in m if "0" <= c <= "9"]


def valid(kind, m):
    d = digits(m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        doubled = [x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))]
        return 14 <= len(d) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        out += [(m.start(), k, m.end(), m.group()) for m in regex.finditer(p, text) if valid(kind, m.group())]
    return sorted(out)


def entity(span):
    value = span[3].lower() if span[1] == 0 else span[3] if span[1] == 1 else "".join(map(str, digits(span[3])))
    return span[1], value


def keys(terms):
    return set(terms) | {t[: sanitize.GENERAL] + "*" for t in terms}


def telling_terms(texts, least, disclosure):
    lines = {line for t in texts for line in (t or "").split("\n") if line.strip(" \t\n\x0b\f\r")}
    own, both, have = {}, {}, {}
    for line in lines:
        for k in keys(WORD.findall(low(line))):
            have[k] = have.get(k, 0) + 1
        seen = {}
        for s in base_spans(line):
            near = seen.setdefault(entity(s), set())
            for m in WORD.finditer(line):
                if max(s[0] - sanitize.REACH, 0) <= m.start() and m.end() <= s[0] or s[2] <= m.start() and m.end() <= s[2] + sanitize.REACH:
                    # a term that touches the end of the reach is left out, cut or not
                    if (m.start() > s[0] - sanitize.REACH or s[0] <= sanitize.REACH) and (m.end() < s[2] + sanitize.REACH or len(line) <= s[2] + sanitize.REACH):
                        near.add(low(m.group()))
        for e, near in seen.items():
            own[e] = own.get(e, 0) + 1
            for k in keys(near):
                both[e, k] = both.get((e, k), 0) + 1
    n, telling = len(lines), set()
    for (e, k), c in both.items():
        if c >= least and own[e] >= least and own[e] < n and math.log(c * n / (own[e] * have[k])) >= disclosure * math.log(n / own[e]):
            telling.add(k)
    return {t: "" if t[: sanitize.GENERAL] + "*" in telling or len(t) <= sanitize.GENERAL else t[: sanitize.GENERAL] + "*" for t in telling if t[-1] != "*"}


def plain(text, telling):
    text = text or ""
    base = base_spans(text)
    terms = [(m.start(), 4, m.end(), low(m.group())) for m in WORD.finditer(text) if low(m.group()) in telling]
    terms = [t for t in terms if not any(b[0] < t[2] and t[0] < b[2] for b in base)]
    out, at = "", 0
    for s in sorted(base + terms):
        if s[2] > at:
            out += text[at : max(s[0], at)]
            if s[0] >= at:
                out += telling[s[3]] if s[1] == 4 else "[" + list(PLAIN)[s[1]].upper() + "]"
            at = s[2]
    return base, terms, out + text[at:]


def corpus(seed):
    draw = random.Random(seed)
    syllables = ["an", "or", "é", "the", "ß", "zo", "ma", "42", "x"]
    words = ["".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))) for _ in range(150)]
    people = [("kim.7@mail.example.com", "zorblax"), ("10.0.255.001", "zoma"), ("4111 1111 1111 1111", "qy"), ("+1 (330) 555-1234", "Vurmelix"), ("9.9.9.9", "the")]
    rows = []
    for i in range(160):
        lines = []
        for _ in range(draw.randint(0, 5)):
            w = [draw.choice(words) for _ in range(draw.randint(0, 60))]
            if draw.random() < 0.25:
                name, term = draw.choice(people)
                at = draw.randint(0, len(w))
                w[at:at] = [name, term.upper() if draw.random() < 0.3 else term][:: draw.choice([1, -1])]
            if draw.random() < 0.04:
                w.append("vurmelix")
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines), 1, "s"))
    rows += [rows[3], (3, "other", 1, ""), (900, None, None, None), (901, "", 0, ""), (None, "kim.7@mail.example.com zorblax", 0, "")]
    return rows


ODD = [
    "a@b.c_x@d.e a@1.2.3.4 x@@y.z q@w a.b@c.d. a@b-.c%d@e.f",
    "1.2.3.4.5.6.7.8 256.1.1.1 0.00.000.0255 1.2.3 01.2.3.4.",
    "4111111111111111 4111-1111-1111-1111 4111 1111 1111 1112 4111  1111 12345678901234567890",
    "+1 (330) 555-1234 +12 +1() 2 +1+12345678901 +1 2 3 4 5 6 7 8 9 0- tel +1234567890123456",
    "9" * 3000 + "." + "a" * 3000 + "@" + "b" * 2000 + "." + "c.d" * 500,
    "@".join(["a.b"] * 400),
    "é😀 a@b.c 😀 1.1.1.1",
    " ".join(["1.1.1.1"] * 300),
]


def test_base_spans_of_odd_texts(spark):
    rows = [(i, t, 0, "") for i, t in enumerate(ODD)]
    got = sanitize.with_base_spans(spark.createDataFrame(rows, SCHEMA).select("doc_id", "text")).collect()
    for r in got:
        assert [tuple(s) for s in r["base"]] == base_spans(ODD[r["doc_id"]]), ODD[r["doc_id"]][:60]


def test_sanitized_against_plain_python(spark):
    for seed, least, disclosure in ((1, 3, 0.95), (2, 2, 0.6)):
        rows = corpus(seed)
        frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
        telling = telling_terms([t for _, t, *_ in rows], least, disclosure)
        found = {r["term"]: r["instead"] for r in sanitize.disclosing_terms(frame.where("text is not null"), least, disclosure).collect()}
        assert found == telling and "zorblax" in telling and "the" not in telling
        got = sanitize.sanitized(frame, least, disclosure)
        want = sorted(((i, *plain(t, telling)) for i, t, *_ in rows), key=str)
        have = [(r["doc_id"], [tuple(s) for s in r["base"]], [tuple(s) for s in r["terms"]], r["sanitized"] or "") for r in got.collect()]
        assert sorted(have, key=str) == want
        names = [*PLAIN, "term"]
        said = lambda spans: ",".join(f"{names[s[1]]}:{s[0]}:{s[2]}" for s in sorted(spans))
        digests = {(r["doc_id"], r["n_card"], r["base_sha256"], r["spans"]) for r in sanitize.digest(got).collect()}
        assert digests == {(i, sum(s[1] == 2 for s in b), hashlib.sha256(said(b).encode()).hexdigest(), said(b + t)) for i, b, t, _ in want}


def test_copies_of_a_line_count_once(spark):
    rows = [(i, "kim@x.org likes only zorblax", 0, "") for i in range(50)] + [(100 + i, f"word{i} other", 0, "") for i in range(50)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sanitize.disclosing_terms(frame).count() == 0
    assert sanitize.digest(sanitize.sanitized(frame.limit(0))).count() == 0


def test_no_python_on_rows(spark):
    frame = spark.createDataFrame(corpus(1), SCHEMA)
    plan = sanitize.digest(sanitize.sanitized(frame))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query_against_sql(spark):
    folder, name = "/root/testdata/sf0.01", "op13_personal_data"
    assert compare(spark, connect(folder), folder, name, catalog.QUERIES[name], catalog.SQL_TWINS[name]) == 1000


def test_query_against_sql_with_disclosing_terms(spark, tmp_path):
    rows = corpus(5)
    spark.createDataFrame(rows, SCHEMA).where("doc_id is not null").withColumn("text", F.col("text")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    name, con = "op13_personal_data", connect(str(tmp_path / "none"))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert compare(spark, con, str(tmp_path), name, catalog.QUERIES[name], catalog.SQL_TWINS[name]) > 100
    assert con.execute(f"SELECT count(*) FROM ({catalog.SQL_TWINS[name]}) WHERE spans LIKE '%term%'").fetchone()[0] > 5
