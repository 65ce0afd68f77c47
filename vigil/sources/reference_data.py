"""Packaged reference tables (IO11): the industry code map and the seed keyword rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Industry code, English name, Korean name.
INDUSTRY_CODES = [
    ("02", "Whole Grains/Milled Grain Products/Starches", "곡류"),
    ("03", "Bakery Products/Dough/Mixes/Icings", "빵류"),
    ("04", "Macaroni/Noodle Products", "면류"),
    ("05", "Cereal Preparations/Breakfast Foods", "곡류가공품"),
    ("07", "Snack Food Items", "과자류"),
    ("09", "Milk/Butter/Dried Milk Products", "유가공품"),
    ("12", "Cheese/Cheese Products", "자연치즈"),
    ("13", "Ice Cream and related Products", "빙과류"),
    ("14", "Filled Milk/Imitation Milk Products", "기타음료"),
    ("15", "Eggs/Egg Products", "알가공품"),
    ("16", "Fishery/Seafood Products", "수산물"),
    ("17", "Meats, Meat Products and Poultry", "축산물"),
    ("18", "Vegetable Protein Products", "두부류 또는 묵류"),
    ("20", "Fruit/Fruit Products", "과일류"),
    ("21", "Fruit/Fruit Products", "과일류"),
    ("22", "Fruit/Fruit Products", "과일류"),
    ("23", "Nuts/Edible Seeds", "땅콩 또는 견과류"),
    ("24", "Vegetables/Vegetable Products", "채소류"),
    ("25", "Vegetables/Vegetable Products", "채소류"),
    ("26", "Vegetable Oils", "식용유지류"),
    ("27", "Dressing/Condiments", "드레싱류"),
    ("28", "Spices, Flavors And Salts", "식품첨가물"),
    ("29", "Drinks, Soft Drinks, and Waters", "음료류"),
    ("30", "Beverage Bases/Concentrates/Nectars", "음료류"),
    ("31", "Coffee/Tea", "다류"),
    ("32", "Alcoholic Beverages", "주류"),
    ("33", "Candy W/O Chocolate/Candy Specialties/Chewing Gums", "캔디류"),
    ("34", "Chocolate/Cocoa Products/Cocoa beans", "초콜릿류"),
    ("35", "Gelatin/Rennet/Pudding Mixes/Pie Fillings", "기타가공품"),
    ("36", "Food Sweeteners/Nutritive syrups/honey/molasses", "기타가공품"),
    ("37", "Multiple food dinners/Gravies/Sauces/Specialties", "소스"),
    ("38", "Soups", "기타가공품"),
    ("39", "Prepared Salad Products", "기타가공품"),
    ("40", "Baby Food Products", "특수용도식품"),
    ("41", "Dietary Conv Food/Meal Replacements", "건강기능식품"),
    ("42", "EDIBLE INSECTS AND INSECT-DERIVED FOODS", "기타가공품"),
    ("45", "Food Additives (Human Use)", "식품첨가물"),
    ("46", "Food Additives (Human Use)", "식품첨가물"),
    ("47", "Multiple Food Warehouses", "기타가공품"),
    ("50", "Color Additiv Food/Drug/Cosmetic", "식품첨가물"),
    ("51", "Food Service/Conveyance", "기타가공품"),
    ("52", "Miscellaneous Food Related Items", "기타가공품"),
    ("53", "Cosmetics", "화장품"),
    ("54", "Vitamins/Minerals (Human/Animal); Proteins", "건강기능식품"),
    ("55", "Pharm Necess & Ctnr For Drug/Bio", "기타가공품"),
    ("56", "Antibiotics (Human/Animal)", "기타가공품"),
    ("57", "Bio & Licensed In-Vivo & In-Vitro Diag", "기타가공품"),
    ("58", "Human/Animal Therapeutic Biologic", "기타가공품"),
    ("59", "Multiple Drug Warehouses", "기타가공품"),
    ("60", "Human and Animal Drugs", "기타가공품"),
    ("61", "Human and Animal Drugs", "기타가공품"),
    ("62", "Human and Animal Drugs", "기타가공품"),
    ("63", "Human and Animal Drugs", "기타가공품"),
    ("64", "Human and Animal Drugs", "기타가공품"),
    ("65", "Human and Animal Drugs", "기타가공품"),
    ("66", "Human and Animal Drugs", "기타가공품"),
    ("67", "Type A Medicated Articles", "기타가공품"),
    ("68", "Animal Devices and Diagnostic Products", "기타가공품"),
    ("69", "Medicated Animal Feeds", "사료"),
    ("70", "Animal Food(Non-Medicated Feed)", "사료"),
    ("71", "Byprodcts For Animal Foods", "사료"),
    ("72", "Pet/Laboratory Animal Food", "사료"),
    ("73", "Anesthesiology", "기타가공품"),
    ("74", "Cardiovascular", "기타가공품"),
    ("75", "Chemistry", "기타가공품"),
    ("76", "Dental", "기타가공품"),
    ("77", "Ear,Nose And Throat", "기타가공품"),
    ("78", "Gastroenterological & Urological", "기타가공품"),
    ("79", "General & Plastic Surgery", "기타가공품"),
    ("80", "General Hospital/Personal Use", "기타가공품"),
    ("81", "Hematology", "기타가공품"),
    ("82", "Immunology", "기타가공품"),
    ("83", "Microbiology", "기타가공품"),
    ("84", "Neurological", "기타가공품"),
    ("85", "Obstetrical & Gynecological", "기타가공품"),
    ("86", "Ophthalmic", "기타가공품"),
    ("87", "Orthopedic", "기타가공품"),
    ("88", "Pathology", "기타가공품"),
    ("89", "Physical Medicine", "기타가공품"),
    ("90", "Radiology", "기타가공품"),
    ("91", "Toxicology", "기타가공품"),
    ("92", "Molecular Genetics", "기타가공품"),
    ("94", "Ionizing Non-Medical Devices", "기타가공품"),
    ("95", "Light Emitting Non-Device Products", "기타가공품"),
    ("96", "Radio Frequency Emitting Products", "기타가공품"),
    ("97", "Sound Emitting Products", "기타가공품"),
    ("98", "Tobacco Products", "기타가공품"),
    ("99", "Bio/Anim Drug/Feed&Food/Med Dev", "기타가공품"),
]

# Keyword, hazard item, middle class, large class, scope.
SEED_RULES = [
    ("알레르기", "표시위반(알러젠)", "표시기준 위반", "표시/기타", "ALL"),
    ("알러지", "표시위반(알러젠)", "표시기준 위반", "표시/기타", "ALL"),
    ("잔류농약", "잔류농약", "잔류농약", "농약", "ALL"),
    ("수입신고", "수입신고 위반", "기타", "표시/기타", "MFDS"),
    ("무신고", "수입신고 위반", "기타", "표시/기타", "MFDS"),
    ("영업등록", "미등록 영업", "기타", "표시/기타", "MFDS"),
    ("무등록", "미등록 영업", "기타", "표시/기타", "MFDS"),
    ("Salmonella", "Salmonella", "식중독균", "미생물", "ALL"),
]


def industry_codes(spark: SparkSession) -> DataFrame:
    """IO11: ``(code, eng, kor, ord)``, a few dozen rows in file order."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(INDUSTRY_CODES)], "code string, eng string, kor string, ord int")


def seed_rules(spark: SparkSession) -> DataFrame:
    """IO11: the first keyword rules ``(keyword, TESTITM_NM, M_KOR_NM, L_KOR_NM, source, rule_ord)``."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(SEED_RULES)],
                                 "keyword string, TESTITM_NM string, M_KOR_NM string, L_KOR_NM string, source string, rule_ord long")
