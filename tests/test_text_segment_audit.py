"""Scalar parsers, segmentation, as-of lookups and the audit."""

import random

from pyspark.sql import functions as F

from vigil.functions import text as X
from vigil.operators import audit as A
from vigil.operators import segment as S
from vigil.sources import html as H


def test_normalize_and_dates(spark):
    df = spark.createDataFrame([("\t Salmon\n ",), (None,), ("2024.1.5",), ("1/5/2024",), ("20240105",),
                                ("garbage",), ("2024-01-05 10:11:12",)], "s string")
    r = df.select(X.normalize("s").alias("n"), X.parse_date_multi("s").alias("d")).collect()
    assert r[0]["n"] == "salmon" and r[1]["n"] == ""
    assert [str(x["d"]) for x in r[2:]] == ["2024-01-05", "2024-01-05", "2024-01-05", "None", "2024-01-05"]


def test_codes_origin_suffix(spark):
    df = spark.createDataFrame([("16 R - - 01 Fish, frozen", "회수 -지역: 베트남 북부 - 제품: 어류", "국내식품 부적합-12345x"),
                                ("no code", "지역 : China, frozen", "x-UNKNOWN"), ("", "none", "plain")], "a string, b string, c string")
    r = df.select(X.product_code("a").alias("code"), X.origin_from_text("b").alias("o"),
                  X.strip_id_suffix("c").alias("s")).collect()
    assert [x["code"] for x in r] == ["16 R - - 01", "", ""]
    assert [x["o"] for x in r] == ["베트남 북부", "China", "Overseas"]
    assert [x["s"] for x in r] == ["국내식품 부적합", "x", "plain"]


def test_segment_blocks(spark):
    lines = ["Intro text", "<H>CHINA", "16 R - - 01 Shrimp", "Date Published: 01/05/2024", "desc 1",
             "Date Published: 02/07/2024", "<H>VIETNAM", "orphan", "16 X - - 02 Squid", "desc 2", "desc 3"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc int, pos int, line string")
    hdr = F.col("line").startswith("<H>")
    code = F.col("line").rlike(X.PRODUCT_CODE_RE)
    date = F.col("line").contains("Date Published:")
    out = S.segment_blocks(df, hdr, code, date, X.us_date_in_text(F.col("line"))).orderBy("block").collect()
    assert [(r["header"], r["opener"], str(r["date"]), r["content"]) for r in out] == [
        ("<H>CHINA", "16 R - - 01 Shrimp", "2024-02-07", "desc 1"),
        ("<H>VIETNAM", "16 X - - 02 Squid", "None", "desc 2\ndesc 3")]


def test_nearest_preceding_matches_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 4), rnd.randint(0, 500), rnd.random() < 0.2, float(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, k long, t long, h boolean, v double")
    out = {r["id"]: r["header_value"] for r in
           S.nearest_preceding(df, "k", "t", "id", F.col("h"), F.col("v"), (F.col("t") / 50).cast("long")).collect()}
    for (i, k, t, _, _) in rows:
        prev = [r for r in rows if r[1] == k and r[3] and (r[2], r[0]) <= (t, i)]
        exp = max(prev, key=lambda r: (r[2], r[0]))[4] if prev else None
        assert out[i] == exp


def test_line_neighbors(spark):
    df = spark.createDataFrame([(1, "a long first line here\nProduct X\nDate Published: 1/2/2024\n\nd1\nd2")],
                               "id int, text string")
    r = S.line_neighbors(df, "id", "text", lambda l, i: l.contains("Date Published")).collect()[0]
    assert (r["above"], r["below"], r["anchor_pos"]) == ("Product X", "d1 d2", 2)


def test_html_lines_links_tables(spark):
    html = ('<html lang="en"><head><title>T &amp; U</title><script>var a="</p>";</script></head><body>'
            '<h1>Head</h1><p>One <b>bold</b></p><!-- c --><ul><li><a href="/x">X</a></li></ul>'
            '<table><tr><td><a href="/a/importalert_1">99-01</a></td><td>Type</td><td>1/2/2024</td><td>Title</td></tr>'
            '<tr><td><a href="importalert_2">Alert</a> 16-02</td><td>2/3/2024</td><td>Other</td></tr>'
            '<tr><td>no link 17-03</td><td>2/3/2024</td><td>Other</td></tr></table></body></html>')
    pages = spark.createDataFrame([(1, "https://h.example.org/p", html)], "page_id int, url string, html string")
    lines = [(r["kind"], r["line"]) for r in H.html_lines(pages, "page_id", "html").orderBy("pos").collect()]
    assert lines[:3] == [("text", "T & U"), ("heading", "Head"), ("text", "One bold")]
    links = H.html_links(pages, "page_id", "html", "url").orderBy("link_pos").collect()
    assert [r["url"] for r in links] == ["https://h.example.org/x", "https://h.example.org/a/importalert_1", "https://h.example.org/importalert_2"]
    rows = H.table_rows(pages, "page_id", "html").orderBy("row_pos").collect()
    assert [(r["alert_no"], r["type"], r["date"], r["title"]) for r in rows] == [
        ("99-01", "Type", "1/2/2024", "Title"), ("16-02", "Unknown", "2/3/2024", "Other")]


def test_audit_planted_gaps(spark):
    df = spark.createDataFrame([
        ("FDA", "Fish", None, "", "Lead", "", True), ("FDA", "Fish", "수산물", "어류", "Lead", "중금속", None),
        ("RASFF", "", None, None, "", None, False), ("MFDS", "Meat", "None", "육류", "Mold", None, True)],
        "data_source string, product_type string, top_level_product_type string, upper_product_type string, "
        "hazard_item string, hazard_class_m string, analyzable boolean")
    miss = {r["column_name"]: (r["missing"], r["status"]) for r in A.audit_missing(df).collect()}
    assert miss["product_type"] == (1, "moderate") and miss["analyzable"] == (1, "moderate")
    assert miss["full_text"] == (None, "absent")
    mp = {(r["raw_col"], r["derived_col"]): r["failures"] for r in A.audit_mapping(df).collect()}
    assert mp[("product_type", "top_level_product_type")] == 2
    assert mp[("product_type", "upper_product_type")] == 1
    assert mp[("hazard_item", "hazard_class_m")] == 2
    s = A.audit_summary(df).collect()[0]
    assert (s["total_rows"], s["n_sources"], s["verdict"]) == (4, 3, "fail")
    assert {(r["source"], r["n_rows"]) for r in A.audit_sources(df).collect()} == {("FDA", 2), ("RASFF", 1), ("MFDS", 1)}
    from vigil.schema import enforce_schema
    assert A.audit_summary(enforce_schema(df)).collect()[0]["verdict"] == "ok"
    kinds = {r["column_name"]: (r["kind"], r["present"]) for r in A.audit_schema(df.withColumn("more", F.lit(1))).collect()}
    assert kinds["more"] == ("extra", 4) and kinds["full_text"] == ("missing", 0) and kinds["hazard_class_m"] == ("order", 2)


def test_salted_top_k_with_hot_group_and_sequential_ids(spark):
    import random as _r
    from vigil.operators.match import top_k_per_group
    from vigil.operators.order import sequential_ids
    rnd = _r.Random(11)
    rows = [("hot" if i % 3 == 0 else f"g{i % 7}", rnd.randint(0, 10_000), f"n{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "grp string, len long, name string")
    got = {}
    for r in top_k_per_group(df, ["grp"], ["len", "name"], 10).collect():
        got.setdefault(r["grp"], []).append((r["len"], r["name"]))
    for g in {r[0] for r in rows}:
        exp = sorted((x[1], x[2]) for x in rows if x[0] == g)[:10]
        assert sorted(got[g]) == exp
    ids = sequential_ids(df.select("name"), "name", "seq", partitions=5).collect()
    by_name = {r["name"]: r["seq"] for r in ids}
    assert [by_name[n] for n in sorted(by_name)] == list(range(1, 3001))


def test_origin_rules(spark):
    """The text after the label up to a dash or the end; then the word after label and colon or dash; blanks give the default."""
    rows = ["-지역: 중국 - 제품: 차", "지역: United States", "지역:   - 제품", "지역-일본어", "지역 : 일본, 수입", "원산지: 중국", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = [r["o"] for r in df.orderBy("i").select(X.origin_from_text("t").alias("o")).collect()]
    assert got == ["중국", "United States", "Overseas", "일본어", "일본", "Overseas", "Overseas", "Overseas"]


def test_name_after_code_takes_what_follows(spark):
    df = spark.createDataFrame([("x 16 R - - 01 - Fish 16 R - - 01, cut", "16 R - - 01"), ("16 R - - 01", "16 R - - 01")], "l string, c string")
    got = [r["n"] for r in df.select(X.name_after_code("l", "c", F.lit("first content line")).alias("n")).collect()]
    assert got == ["Fish 16 R - - 01, cut", "first content line"]


def test_sequential_ids_of_many_unsorted_wide_rows(spark):
    from vigil.operators.order import sequential_ids

    n = 2_000_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).alias("k"), F.concat(F.lit("x" * 40), F.col("id")).alias("wide"))
    got = sequential_ids(df, "k", partitions=16)
    bad = got.where("seq <> k + 1 or length(wide) < 41").count()
    assert bad == 0 and got.count() == n


def test_sequential_ids_with_ties_and_nulls(spark):
    from vigil.operators.order import sequential_ids

    df = spark.createDataFrame([(v,) for v in ["b", None, "a", "b", None, "c"]], "k string")
    got = sequential_ids(df, "k", partitions=3).orderBy("seq").collect()
    assert [r["seq"] for r in got] == list(range(1, 7)) and [r["k"] for r in got] == [None, None, "a", "b", "b", "c"]
    assert sequential_ids(df.where("k = 'z'"), "k").collect() == []


def test_nearest_header_of_a_hot_day_is_spread_over_tasks(spark):
    import random

    rnd = random.Random(9)
    rows = [("hot", 7, rnd.randrange(1000), i, rnd.random() < 0.01, None if rnd.random() < 0.3 else f"v{i}") for i in range(3000)]
    rows += [(rnd.choice(["a", "b", None]), rnd.randrange(5), rnd.randrange(1000), 5000 + i, rnd.random() < 0.2, f"v{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "k string, day int, t int, i int, h boolean, v string").withColumn("at", F.col("day") * 1000 + F.col("t")).repartition(4)
    want, last = {}, {}
    for k, day, t, i, h, v in sorted(rows, key=lambda r: (r[1] * 1000 + r[2], r[3])):
        if h and v is not None:
            last[k] = v
        want[i] = last.get(k)
    for slot in (None, F.floor(F.col("t") / 50)):
        out = S.nearest_preceding(df, "k", "at", "i", F.col("h"), F.col("v"), F.col("day"), slot=slot)
        assert {r["i"]: r["header_value"] for r in out.collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join such small pieces again
    try:
        held = out.where("k = 'hot'").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(held) > 1 and max(r["count"] for r in held) < 3000


def test_segments_of_a_long_document_are_carried_over_its_pieces(spark):
    rnd = random.Random(12)
    rows = [(d, p, rnd.choice(["H1", "H2", "c7", "c8", "2024", "text", "more", "", None])) for d, n in (("long", 400), ("short", 9), (None, 60)) for p in range(n)]
    df = spark.createDataFrame(rows, "doc string, pos int, line string").repartition(3)
    flags = F.col("line").startswith("H"), F.col("line").startswith("c"), F.col("line") == "2024"
    want = []
    for d in ("long", "short", None):
        header, open_, n = None, None, 0
        for p, line in [(p, x) for e, p, x in rows if e == d and x]:
            if line[0] in "Hc":
                n += 1
                if open_:
                    want.append(open_)
                header, open_ = (line, None) if line[0] == "H" else (header, [d, n + 0, header, line, None, []])
                open_ = open_ if header else None
            elif open_ and line == "2024":
                open_[4] = p
            elif open_:
                open_[5].append(line)
        if open_:
            want.append(open_)
    for piece in (7, 64, 4096):
        out = S.segment_blocks(df, *flags, F.col("pos"), piece=piece)
        got = [[r["doc"], r["block"], r["header"], r["opener"], r["date"], r["content"], r["n_lines"]] for r in out.collect()]
        assert sorted(map(str, got)) == sorted(str([*w[:5], "\n".join(w[5]), len(w[5])]) for w in want)


def test_facet_lists_read_the_table_once(spark):
    from collections import Counter

    from vigil.operators import metrics as Q

    rows = [(["a", "b", None, ""][i % 4], i % 3 if i % 7 else None, f"v{i % 5}") for i in range(200)]
    df = spark.createDataFrame(rows, "x string, y int, z string")
    want = Counter()
    for x, y, z in rows:
        if x:
            want[0, "x", x] += 1
        if x in ("a", None, "") and x == "a":
            if y is not None:
                want[1, "y", str(y)] += 1
            if y in (0, 2):
                want[2, "z", z] += 1
    out = Q.facet_lists(df, [("x", "a"), ("y", [0, 2]), ("z", Q.ALL)])
    assert {(r["level"], r["facet"], r["value"]): r["n"] for r in out.collect()} == want
    plan = Q.facet_lists(spark.read.parquet("/root/testdata/sf0.001/part.parquet"), [("p_type", "SMALL"), ("p_size", [1]), ("p_brand", None)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_states_of_runs_add_up_to_the_whole_table(spark):
    rows = [(f"s{i % 3}" if i % 11 else None, f"id{i % 700}", "" if i % 4 == 0 else "x", True if i % 5 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "data_source string, source_detail string, product_type string, analyzable boolean").repartition(3)
    runs = [df.where("product_type = ''"), df.where("product_type <> ''"), df.limit(0)]
    states = [A.run_state(r, f"r{i}", distinct_cols=["source_detail"]) for i, r in enumerate(runs)]
    states.append(A.run_state(runs[0], "r0", distinct_cols=["source_detail"]))  # written again by a retry
    folded = A.fold_states(states[0].unionByName(states[1]).unionByName(states[2]).unionByName(states[3]))
    key = lambda r: str(tuple(r))
    assert sorted(A.folded_missing(folded).collect(), key=key) == sorted(A.audit_missing(df).collect(), key=key)
    assert sorted(map(tuple, A.folded_sources(folded).collect())) == sorted(map(tuple, A.audit_sources(df).collect()))
    got = [r["n_distinct"] for r in folded.where("check = 'distinct'").collect()]
    assert len(got) == 1 and abs(got[0] - 700) <= 0.05 * 700  # lgConfigK 12: about 1.6 % standard error
