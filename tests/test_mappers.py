"""Per-source mappers on reference-shaped raw rows and mock dictionaries."""

import pytest
from pyspark.sql import functions as F

from vigil.schema import UNIFIED_COLUMNS
from vigil.sources import mappers as MP


@pytest.fixture(scope="module")
def refs(spark):
    products = spark.createDataFrame([
        ("P1", None, None, "수산물", "Seafood", 0), ("P2", "P1", "P1", "갑각류", "Crustacean", 1),
        ("P3", "P2", "P1", "새우", "Shrimp", 2), ("P4", "P1", "P1", "어류", "Fish", 3), ("P5", "P4", "P1", "연어", "Salmon", 4),
    ], "PRDLST_CD string, HRNK_PRDLST_CD string, HTRK_PRDLST_CD string, KOR_NM string, ENG_NM string, row_ord long")
    hazards = spark.createDataFrame([
        ("살모넬라", "Salmonella", "SAL", "살모넬라균", "살모넬라", "미생물", "생물학적", True, True, 0),
        ("아플라톡신", "Aflatoxin", "AFL", "곰팡이독소", "아플라톡신", "곰팡이독소", "화학적", True, True, 1),
        ("납", "Lead", None, None, "납", "중금속", "화학적", True, False, 2),
    ], "KOR_NM string, ENG_NM string, ABRV string, NCKNM string, TESTITM_NM string, M_KOR_NM string, "
       "L_KOR_NM string, ANALYZABLE boolean, INTEREST_ITEM boolean, row_ord long")
    rules = spark.createDataFrame([
        ("이물", "이물", "이물질", "물리적", "ALL", 0), ("glass", "유리", None, None, "FDA", 1)],
        "keyword string, TESTITM_NM string, M_KOR_NM string, L_KOR_NM string, source string, rule_ord long")
    return MP.References(products, hazards, rules)


def test_i2620(spark, refs):
    raw = spark.createDataFrame([
        ("2024.01.05", "냉동새우", "새우", "살모넬라", "11", 1), ("2024.01.05", "dup", "새우", "x", "11", 2),
        ("2024.01.06", "연어필렛", "Salmon", "미지항목", "", 3)],
        "CRET_DTM string, PRDTNM string, PRDLST_CD_NM string, TEST_ITMNM string, RTRVLDSUSE_SEQ string, o long")
    out = {r["source_detail"]: r for r in MP.map_i2620(raw, refs, order_col="o").collect()}
    assert set(out) == {"국내식품 부적합-11", "국내식품 부적합-UNKNOWN"}
    a = out["국내식품 부적합-11"]
    assert (a["registration_date"], a["product_name"], a["top_level_product_type"], a["upper_product_type"]) == \
        ("2024-01-05", "냉동새우", "수산물", "갑각류")
    assert (a["hazard_class_m"], a["hazard_class_l"], a["analyzable"], a["interest_item"]) == ("미생물", "생물학적", True, True)
    b = out["국내식품 부적합-UNKNOWN"]
    assert (b["upper_product_type"], b["hazard_class_m"], b["analyzable"]) == ("어류", "미지항목", False)


def test_i0490_rules_and_scan(spark, refs):
    raw = spark.createDataFrame([
        ("2024-02-01 10:00:00", "과자", "새우", "이물 혼입 및 Salmonella 검출", "1"),
        ("2024-02-02 10:00:00", "쌀", "쌀", "aflatoxin b1 exceeded", "2"),
        ("2024-02-03 10:00:00", "물", "물", "unknown reason", "3")],
        "CRET_DTM string, PRDTNM string, PRDLST_CD_NM string, RTRVLPRVNS string, RTRVLDSUSE_SEQ string")
    out = {r["source_detail"][-1]: r for r in MP.map_i0490(raw, refs).collect()}
    assert (out["1"]["hazard_item"], out["1"]["hazard_class_m"], out["1"]["hazard_class_l"]) == ("이물", "이물질", "물리적")
    assert (out["2"]["hazard_item"], out["2"]["hazard_class_m"], out["2"]["registration_date"]) == \
        ("아플라톡신", "곰팡이독소", "2024-02-02")
    assert (out["3"]["hazard_item"], out["3"]["hazard_class_m"]) == ("unknown reason", "unknown reason")


def test_i2810_rasff_impfood(spark, refs):
    raw = spark.createDataFrame([("20240301", "Cheese", "Lead", "-지역: 프랑스 - 수입 금지", "N-1"),
                                 ("bad", "Tea", "", "no origin", "")],
                                "CRET_DTM string, TITL string, DETECT_TITL string, BDT string, NTCTXT_NO string")
    r = {x["source_detail"]: x for x in MP.map_i2810(raw, refs).collect()}
    a = r["해외 위해식품 회수-N-1"]
    assert (a["registration_date"], a["origin_country"], a["hazard_item"], a["product_type"]) == \
        ("2024-03-01", "프랑스", "납", "수입식품(해외회수)")
    assert r["해외 위해식품 회수-UNKNOWN"]["origin_country"] == "Overseas"
    ras = MP.map_rasff(spark.createDataFrame([("05/01/2024", "2024.001", "China", "Salmonella in chicken", "poultry"),
                                              ("junk", "2024.002", "Peru", "x", "fruit")],
                                             "date string, reference string, origin string, subject string, category string"))
    rr = sorted((x["registration_date"], x["hazard_item"], x["hazard_class_m"]) for x in ras.collect())
    assert rr == [("", "x", "Uncategorized"), ("2024-01-05", "Salmonella in chicken", "Uncategorized")]
    imp = spark.createDataFrame([("7", "2024-04-01", "연어", "Salmon", "연어", "Norway", "납 기준 초과")],
                                "id string, date string, name_kr string, name_en string, product_type string, "
                                "origin string, reason string")
    x = MP.map_impfood(imp, refs).collect()[0]
    assert (x["product_name"], x["source_detail"], x["hazard_item"], x["hazard_class_m"], x["upper_product_type"]) == \
        ("연어 (Salmon)", "ImpFood-7", "납", "중금속", "어류")


def test_fda_blocks(spark, refs):
    blocks = spark.createDataFrame([
        ("CHINA", "16 R - - 01 - Shrimp, frozen", "1/5/2024", "broken glass found", "99-01", 1),
        ("PERU", "16 X - - 02 Fish", "2/7/2024", "aflatoxin detected", "99-02", 1),
        ("PERU", "16 X - - 02", "2/7/2024", "first line\nmore", "99-02", 2),
        ("PERU", "no code line", None, "text", "99-03", 1)],
        "header string, opener string, date string, content string, alert_no string, block long")
    ov = spark.createDataFrame([("99-02", None, "Manual type")], "alert_no string, Manual_Hazard_Item string, "
                                                                 "Manual_Product_Type string")
    full = MP.map_fda(blocks, refs, ov, force=True).collect()
    bare = [r for r in full if r["full_text"] == "16 X - - 02\nfirst line\nmore"]
    assert [r["product_name"] for r in bare] == ["first line"]   # nothing after the code: the first content line
    out = {r["source_detail"]: r for r in full if r not in bare}
    assert out["FDA Import Alert_99-01"]["full_text"] == "16 R - - 01 - Shrimp, frozen\nbroken glass found"
    assert set(out) == {"FDA Import Alert_99-01", "FDA Import Alert_99-02"}
    a = out["FDA Import Alert_99-01"]
    assert (a["product_type"], a["product_name"], a["hazard_item"], a["registration_date"], a["origin_country"]) == \
        ("16 R - - 01", "Shrimp, frozen", "유리", "2024-01-05", "CHINA")
    b = out["FDA Import Alert_99-02"]
    assert (b["product_type"], b["hazard_item"], b["hazard_class_m"]) == ("Manual type", "아플라톡신", "곰팡이독소")
    only = MP.map_fda(blocks, refs, force=False, target_date="2024-02-07").collect()
    assert {r["source_detail"] for r in only} == {"FDA Import Alert_99-02"} and len(only) == 2
    refs.countries = spark.createDataFrame([("China", "중국", 0), ("Peru", "페루", 1)], "en string, ko string, ord int")
    try:
        assert {r["origin_country"] for r in MP.map_fda(blocks, refs, ov, force=True).collect()} == {"China", "Peru"}
    finally:
        refs.countries = None
    assert list(MP.map_source("RASFF", spark.createDataFrame([], "date string, reference string, origin string, "
                                                                 "subject string, category string")).columns) == UNIFIED_COLUMNS


def test_registered_source_is_mapped_onto_the_unified_table(spark):
    MP.register_source("Own", lambda raw, refs: raw.select(F.col("d").alias("registration_date"), F.lit("Own").alias("data_source")))
    try:
        out = MP.map_source("Own", spark.createDataFrame([("2024.1.5",), ("?",)], "d string"))
        assert out.columns == UNIFIED_COLUMNS and sorted(r["registration_date"] for r in out.collect()) == ["", "2024-01-05"]
    finally:
        del MP.SOURCES["Own"]


def test_i2810_rows_of_one_number_stay_apart(spark, refs):
    raw = spark.createDataFrame([("20240301", "A", "Lead", "-지역: 중국", ""), ("20240301", "B", "Mold", "-지역: 일본", ""),
                                 ("20240301", "B", "Mold", "-지역: 일본", "")],
                                "CRET_DTM string, TITL string, DETECT_TITL string, BDT string, NTCTXT_NO string")
    got = sorted((r["product_name"], r["origin_country"]) for r in MP.map_i2810(raw, refs).collect())
    assert got == [("A", "중국"), ("B", "일본"), ("B", "일본")]
