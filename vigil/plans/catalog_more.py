"""Query catalogue, part 5: landed pages to fields, packaged reference tables, text readers, and the
smaller maintenance operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import text as X
from vigil.operators import audit as A
from vigil.operators import lookup as L
from vigil.operators import match as MT
from vigil.operators import merge as M
from vigil.operators import metrics as Q
from vigil.plans.catalog import T, _customer_patch, _doc_notices, query
from vigil.schema import DISPLAY_HEADERS, empty_unified, ensure_columns, enforce_schema, rename_columns, select_columns
from vigil.session import scratch_path
from vigil.sources import html as H
from vigil.sources import io as IO
from vigil.sources import mappers as MP
from vigil.sources import reference_data as R


def _alert_pages(spark, sf):
    """Pages with an alert index row, an alert text and listing cards of their own values around them."""
    p = T(spark, sf, "pages")
    n = F.length("html")
    no = F.concat((n % 90 + 10).cast("string"), F.lit("-"), F.lpad((n % 50).cast("string"), 2, "0"))
    row = F.concat(F.lit('<table><tr><td><a href="/x/importalert_'), n.cast("string"), F.lit('.html">'),
                   F.when(n % 3 == 0, no).otherwise(F.lit("Some title")), F.lit("</a> no "), no, F.lit("</td>"),
                   F.when(n % 2 == 0, F.lit("<td>DWPE</td><td>01/02/2024</td><td>Fish &amp; more</td>"))
                   .when(n % 5 == 0, F.lit("<td>01/03/2024</td><td>Tea</td>")).otherwise(F.lit("")),
                   F.lit("</tr><tr><td>01/02/2024</td><td>R-"), n.cast("string"),
                   F.lit("</td><td>China</td><td>lead in tea</td><td>tea</td></tr></table>"))
    desc = (F.when(n % 3 == 0, F.concat(F.lit("<h3>Product Description:</h3><p> </p><div><b>All</b> "), F.repeat(F.lit("frozen fish "), 60), F.lit("</div>")))
            .when(n % 3 == 1, F.lit("<p>Product Description:</p><p>dried fruit</p><p>Next</p>")).otherwise(F.lit("")))
    charge = F.when(n % 2 == 0, F.lit("<p>OASIS charge code: FILTHY</p><p>Yellow  List and Green List</p>")).otherwise(F.lit(""))
    cards = F.concat(F.lit("<ul><li><strong title='제품한글명'> 차 "), n.cast("string"), F.lit("</strong><span title='제조국가'>중국</span></li>"),
                     F.lit("<li><strong title='제품한글명'>떡</strong></li></ul>"))
    return p.select("page_id", F.concat(row, charge, desc, cards, F.col("html")).alias("html"))


@query
def index_rows(spark, sf):
    """IO9 + S10: alert fields of index-table rows."""
    return H.table_rows(_alert_pages(spark, sf), "page_id", "html")


@query
def html_meta(spark, sf):
    """Charge code line, list flags and product description of alert pages."""
    return H.page_meta(_alert_pages(spark, sf), "page_id", "html")


@query
def card_fields(spark, sf):
    """IO10: titled fields of listing cards."""
    out = H.titled_fields(_alert_pages(spark, sf), "page_id", "html", {"name_kr": "제품한글명", "origin": "제조국가"},
                          item_re=r"(?is)<li>(<strong title='제품한글명'>.*?)</li>")
    return out


@query
def listing_notices(spark, sf):
    """IO10 + P8: listing pages straight into the listing mapper."""
    return MP.map_rasff(H.listing_rows(_alert_pages(spark, sf), "page_id", "html"))


@query
def industry_types(spark, sf):
    """IO11 + J13 + S7 + S8: product code and name out of a product line, the type by the packaged industry map."""
    p = T(spark, sf, "part").select("p_partkey", F.lit("").alias("manual"), F.concat(
        F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(" A - B 07"), F.when(F.col("p_type") != "PROMO", F.concat(F.lit(" - , "), "p_name")).otherwise(F.lit(" -"))).alias("line"))
    p = p.withColumn("code", X.product_code("line")).withColumn("industry", X.industry_of("code"))
    out = L.priority_type(p, "industry", "manual", R.industry_codes(spark), "code", "kor", "ord")
    return out.select("p_partkey", "code", X.name_after_code("line", "code", F.lit("first content line")).alias("name"), "product_type")


@query
def seed_rule_scan(spark, sf):
    """IO11 + M6 + J6: the packaged rules over all documents with planted keywords; the rule's classes."""
    d = T(spark, sf, "documents").select(
        "doc_id", F.when(F.col("source") == "src1", F.lit("MFDS")).otherwise(F.lit("FDA")).alias("src"),
        F.concat("text", F.when(F.length("text") % 3 == 0, F.lit(" 무신고 salmonella")).when(F.length("text") % 3 == 1, F.lit(" 알레르기")).otherwise(F.lit(""))).alias("t"))
    rules = R.seed_rules(spark)
    hits = MT.rule_scan(d, "t", "src", rules, key="doc_id")
    return hits.join(rules, "rule_ord").select("doc_id", "TESTITM_NM", "M_KOR_NM", "L_KOR_NM")


@query
def country_master(spark, sf):
    """IO3: tab-separated country master, written and read by position; NA stays text."""
    path = scratch_path(spark, "countries")
    n = T(spark, sf, "nation")
    n.select(F.col("n_name").alias("English"), F.concat(F.lit("국가"), "n_nationkey").alias("Korean"),
             F.when(F.col("n_nationkey") % 2 == 0, F.lit("NA")).alias("ISO2")).write.option("sep", "\t").option("header", True).csv(path)
    return IO.read_tsv(spark, path, ["en", "ko", "iso2"])


@query
def rules_load(spark, sf):
    """IO4 + IO5 + S18: a rules CSV, every value a string, then its flag as a boolean."""
    path = scratch_path(spark, "rules")
    p = T(spark, sf, "part")
    flag = F.when(F.col("p_size") < 10, F.lit("True")).when(F.col("p_size") < 20, F.lit("yes")).when(F.col("p_size") < 30, F.lit("0")) \
        .when(F.col("p_size") < 40, F.lit("no"))
    p.select(F.col("p_partkey").alias("Alert_No"), F.col("p_name").alias("keyword"), flag.alias("IsCollect")).write.option("header", True).csv(path)
    r = IO.read_csv_strings(spark, path)
    return r.select("Alert_No", "keyword", X.to_bool(F.col("IsCollect")).alias("IsCollect"))


@query
def cp949_rules(spark, sf):
    """IO6: a rules CSV in the Korean code page, written and read back, its flag as a boolean."""
    path, charset = scratch_path(spark, "cp949"), "spark.sql.legacy.javaCharsets"
    p = T(spark, sf, "part")
    rows = p.select(F.concat(F.lit("수입-"), F.col("p_partkey")).alias("Alert_No"), F.concat(F.col("p_name"), F.lit(" 식품")).alias("keyword"),
                    F.when(F.col("p_size") < 25, F.lit("true")).otherwise(F.lit("no")).alias("IsCollect"))
    before = spark.conf.get(charset)
    spark.conf.set(charset, "true")
    try:
        rows.write.option("header", True).option("encoding", "x-windows-949").csv(path)
        r = MT.materialize(IO.read_csv_strings(spark, path, encoding="x-windows-949"))
    finally:
        spark.conf.set(charset, before)
    return r.select("Alert_No", "keyword", X.to_bool(F.col("IsCollect")).alias("IsCollect"))


@query
def bom_export(spark, sf):
    """IO16: a CSV export under Korean headers, a byte-order mark in front of every part, read back by its headers."""
    path = scratch_path(spark, "export")
    o = T(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("source_detail"), F.col("o_orderstatus").alias("product_type"),
                                      F.col("o_orderpriority").alias("hazard_item"))
    IO.export_csv_bom(rename_columns(o, DISPLAY_HEADERS), path)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    marked = raw.agg(F.min(F.hex(F.substring("content", 1, 3)) == "EFBBBF")).scalar()
    back = IO.read_csv_strings(spark, path)
    return rename_columns(back, {v: k for k, v in DISPLAY_HEADERS.items()}).withColumn("marked", marked)


@query
def empty_start(spark, sf):
    """IO12: the first rows of a table that begins empty, under the unified schema."""
    o = T(spark, sf, "orders")
    raw = o.select(F.to_date("o_orderdate").alias("registration_date"), F.col("o_orderstatus").alias("data_source"),
                   F.concat(F.lit("O-"), F.col("o_orderkey")).alias("source_detail"), F.col("o_orderpriority").alias("hazard_item"))
    return empty_unified(spark).unionByName(enforce_schema(raw))


@query
def current_master(spark, sf):
    """IO14 + J7: a master read through its pointer after it was rewritten twice, the second time from itself."""
    root = scratch_path(spark, "master")
    s = T(spark, sf, "supplier")
    IO.publish(s.withColumn("IS_MANUAL_FIXED", F.col("s_acctbal") < 0), root)
    new = s.select("s_suppkey", F.upper("s_name").alias("s_name"), "s_nationkey", (F.col("s_acctbal") + 1).alias("s_acctbal"), F.lit(False).alias("IS_MANUAL_FIXED"))
    IO.publish(M.pinned_merge(new, IO.read_current(spark, root), "s_suppkey"), root)
    return IO.read_current(spark, root).select("s_suppkey", "s_name", "s_acctbal", "IS_MANUAL_FIXED")


@query
def snapshot_buckets(spark, sf):
    """J16 by digests: two stored copies, of which only buckets with other digests are compared."""
    c, p = _customer_patch(spark, sf)
    patched = M.patch_all(c, p, "c_custkey", ["c_acctbal", "c_name"], changed_col=None).where(F.col("c_mktsegment") != "FURNITURE")
    cols = ["c_name", "c_acctbal", "c_mktsegment"]
    a, b = (M.write_snapshot(x, scratch_path(spark, "snapshot"), "c_custkey", cols, 32) for x in (c, patched))
    return M.snapshot_diff_stored(spark, a, b, "c_custkey", cols).select("c_custkey", "side", F.array_join("changed", ",").alias("changed"))


@query
def changed_alerts(spark, sf):
    """J8 by digests: orders that are new or updated since the stored snapshot."""
    o = T(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    old = o.where(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")).select("o_orderkey", day.alias("pub_date"), (F.col("o_orderpriority") != "5-LOW").alias("IsCollect"))
    new = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.date_add(day, 1)).otherwise(day).alias("pub_date"), F.lit(True).alias("IsCollect"))
    stored = M.write_snapshot(old, scratch_path(spark, "index"), "o_orderkey", ["pub_date"], 32)
    return M.changes_since(new, stored, "o_orderkey", "pub_date", ["IsCollect"], 32)


def _folded(spark, sf):
    """States of two runs over the documents' notices, stored run by run, the second one twice."""
    path, d = scratch_path(spark, "states"), _doc_notices(spark, sf)
    for run, rows in (("r1", d.where("product_type = 'en'")), ("r2", d.where("product_type <> 'en'")), ("r2", d.where("product_type <> 'en'"))):
        IO.append(A.run_state(rows, run), path, ["run_id"])
    return A.fold_states(spark.read.parquet(path))


@query
def folded_audit(spark, sf):
    """A10 after each run: missing values per column from the runs' states, the table not read again."""
    return A.folded_missing(_folded(spark, sf))


@query
def folded_sources(spark, sf):
    """A13 after each run: rows of every source from the runs' states."""
    return A.folded_sources(_folded(spark, sf))


@query
def facet_cascade(spark, sf):
    """F6 + F7 + A8: the value lists of three facets, each under the selections before it, in one scan."""
    return Q.facet_lists(T(spark, sf, "part"), [("p_type", "SMALL"), ("p_size", list(range(1, 21))), ("p_brand", Q.ALL)])


@query
def cleared_runs(spark, sf):
    """IO18: a table of runs cleared by an empty next version and filled again; rows of what readers saw before, between and after."""
    root = scratch_path(spark, "runs")
    runs = T(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    seen = []
    for step, state in (("filled", runs), ("cleared", runs.limit(0)), ("again", runs.where("o_orderstatus = 'F'"))):
        IO.publish(state, root)
        seen.append(IO.read_current(spark, root).agg(F.count(F.lit(1)).alias("n_rows"), F.min("o_orderkey").alias("first_key")).withColumn("step", F.lit(step)))
    return seen[0].unionByName(seen[1]).unionByName(seen[2])


@query
def named_source(spark, sf):
    """2.12a: a source registered by name and mapped by it."""
    MP.register_source("ORDERS", lambda raw, refs=None: raw.select(
        F.to_date("o_orderdate").alias("registration_date"), F.lit("ORDERS").alias("data_source"),
        F.concat(F.lit("O-"), F.col("o_orderkey")).alias("source_detail"), F.col("o_orderpriority").alias("hazard_item"),
        (F.col("o_totalprice") > 200000).alias("analyzable"), F.col("o_custkey").alias("not_a_column")))
    return MP.map_source("ORDERS", T(spark, sf, "orders"))


@query
def work_list(spark, sf):
    """J8 + F11: alerts that need detail work: new or updated, and collectable; with their last date."""
    o = T(spark, sf, "orders")
    old = o.where(F.col("o_orderstatus") != "O").select("o_orderkey", F.to_date("o_orderdate").alias("pub"), (F.col("o_orderpriority") != "5-LOW").alias("IsCollect"))
    new = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.date_add(F.to_date("o_orderdate"), 3)).otherwise(F.to_date("o_orderdate")).alias("pub"),
                   F.lit(True).alias("IsCollect"))
    return M.work_list(M.change_detect(new, old, "o_orderkey", "pub", ["IsCollect"]), "pub").select("o_orderkey", "status", "Last_Updated_Date")


@query
def update_report(spark, sf):
    """How many alerts a patch has changed, and the first five of them."""
    p = T(spark, sf, "part").select("p_partkey", (F.col("p_size") > 25).alias("before"), (F.col("p_retailprice") > 1200).alias("after"))
    return M.update_report(p.withColumn("changed", F.col("before") != F.col("after")), "p_partkey", "changed")


@query
def date_rejects(spark, sf):
    """F16: rows whose date can't be read are set aside with the raw value; the others go on."""
    o = T(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("?"), "o_orderpriority"))
                                      .otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("raw"))
    good, bad = X.split_rejects(o, "raw", X.compact_date(F.col("raw")), "day")
    return good.select("o_orderkey", "raw", "day", F.lit(False).alias("rejected")).unionByName(
        bad.select("o_orderkey", "raw", "day", F.lit(True).alias("rejected")))


@query
def name_rows(spark, sf):
    """all rows of one chosen name, selected columns."""
    p = T(spark, sf, "part")
    return Q.rows_of(p, "p_type", "PROMO", ["p_partkey", "p_name", "p_size"])


@query
def manual_insert(spark, sf):
    """U5 + J17: rows put in by hand: codes from the chosen category, a key from the content, pinned and in use."""
    c, n = T(spark, sf, "customer"), T(spark, sf, "nation")
    master = n.select(F.concat(F.lit("N"), "n_nationkey").alias("PRDLST_CD"), F.col("n_name").alias("KOR_NM"),
                      F.concat(F.lit("R"), "n_regionkey").alias("HTRK_PRDLST_CD"))
    wanted = c.select(F.col("c_name").alias("KOR_NM"), F.concat(F.lit("N"), "c_nationkey").alias("category"))
    return M.manual_rows(wanted, "category", master, "PRDLST_CD", {"PRDLST_CD": "HRNK_PRDLST_CD", "HTRK_PRDLST_CD": "HTRK_PRDLST_CD"}, ["KOR_NM", "category"])


@query
def keep_manual(spark, sf):
    """F15 + M13: names are proposed only where none is set by hand."""
    from vigil.plans.catalog_match import word_dict
    d = T(spark, sf, "documents").select("doc_id", F.col("text").alias("title"), F.when(F.col("source") == "src0", F.concat(F.lit("hand "), "lang")).alias("manual"))
    wd = word_dict(spark, sf)
    open_ = d.where(F.col("manual").isNull())
    m = MT.override_word(open_, "title", MT.prepare_terms(wd, ["ENG_NM"], min_len=4), min_len=4, key="doc_id")
    auto = m.join(wd.select("row_ord", "KOR_NM"), "row_ord").select("doc_id", F.col("KOR_NM").alias("auto"))
    return d.select("doc_id", "manual").join(auto, "doc_id", "left").select("doc_id", F.coalesce("manual", "auto").alias("name"))


@query
def spec_fill(spark, sf):
    """Hazard specs filled name first, then the classes that follow from the name."""
    n, r = T(spark, sf, "nation"), T(spark, sf, "region")
    dim = n.select(F.concat(F.lit("H"), "n_nationkey").alias("code"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"))
    classes = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("cname"), F.col("r_name").alias("class_l"), F.upper("n_name").alias("class_m"), F.col("n_nationkey").alias("o"))
    c = T(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select("c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit("H"), (F.col("c_nationkey") + F.when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(0)))).alias("code"),
                    F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.col("n_name")).alias("name"))
    filled = L.bidi_fill(rows, "code", "name", dim, "code", "name", "ord", code_first=False)
    return L.first_row_join(filled, "name", classes, "cname", "o", ["class_l", "class_m"]).select("c_custkey", "code", "name", "class_l", "class_m")


@query
def audit_sources(spark, sf):
    """Rows of every source."""
    return A.audit_sources(_doc_notices(spark, sf))


@query
def full_audit(spark, sf):
    """The audits' findings as one table."""
    return A.full_audit(_doc_notices(spark, sf))


@query
def monitored(spark, sf):
    """only the rows whose flag is on."""
    o = T(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice") > 200000).alias("IsCollect"))
    return Q.flag_filter(o, "IsCollect", True)


@query
def default_columns(spark, sf):
    """Columns that a master lacks, added with their defaults; the ones it has stay."""
    s = T(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("USE_YN"))
    return ensure_columns(s, {"IS_MANUAL_FIXED": False, "USE_YN": "Y", "note": ""})


@query
def header_view(spark, sf):
    """P3 + P4: columns picked by their display headers, shown under them, and renamed back."""
    n = enforce_schema(T(spark, sf, "nation").select(F.col("n_name").alias("origin_country"), F.col("n_name").alias("full_text")))
    shown = rename_columns(select_columns(n, exclude_keywords=["분류", "품목", "여부"], header_map=DISPLAY_HEADERS, always_keep=["analyzable"]), DISPLAY_HEADERS)
    back = rename_columns(shown, DISPLAY_HEADERS, inverse=True)
    return back.select("origin_country", "full_text", F.lit(len(back.columns)).alias("n_columns"))


@query
def map_fda_dated(spark, sf):
    """F12 + T3: only alert blocks of one date."""
    from vigil.plans.catalog_sources import alert_blocks, references
    return MP.map_fda(alert_blocks(spark, sf), references(spark, sf), target_date="2024-01-03")
