"""Queries of the text normalisers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.functions import similarity, text
from samewise.plans.registry import in_steps, query, quoted, sql_replaced, sql_without
from samewise.sources.tables import named_documents, parts, table

#: Small tables of our own, suited to the test tables.
CATEGORY_GROUPS = (("economy", "promo"), ("standard", "medium"), ("large",))
KEYWORD_CLASSES = {1: ("ring", "gizmo"), 2: ("plate", "rod"), 3: ("red", "blue"), 4: ("PROMO", "ECONOMY")}
CATEGORY_WORDS = {"jewel": ("ring",), "metal": ("rod", "plate"), "tool": ("widget", "gizmo")}
SPELLINGS = {"small ": "little ", "large ": "big ", "hot ": "warm "}
ALIASES = {"red plate": "plate", "red ring": "ring", "blue ring": "ring", "small widget": "widget"}
WORD_TRANSLATIONS = {"the": "north", "of": "building", "and": "street"}
DICTIONARY = {"la": "the", "de": "of", "und": "and", "der": "the", "que": "that"}
CITY_PASSES = ({"unitedstates": "us", "us": "usa", "china": "cn", "algeria": "dz"}, {"usa": "america", "dz": "algeria"})
BRANDS = ("7/11#a", "my 7-11 x", "7-eleven", "sea world", "mc donalds x", "mcd house", "best kepab", "aloonaloon", "x internationalairport", "a™b®c", "restoram")

NAME = "SELECT doc_id AS id, left(text, 76) AS name FROM documents"
X = "SELECT doc_id AS id, left(text, 76) AS x FROM documents"


def sql_plain(e: str) -> str:
    return sql_replaced(f"translate({e}, {quoted(text.ACCENTED)}, {quoted(text.PLAIN)})", text.LONG_LETTERS)


def sql_normal(e: str, spaces: bool = True) -> str:
    return sql_without(f"lower({sql_plain(e)})", text.SYMBOLS if spaces else " " + text.SYMBOLS)


STOP_STEPS = [f"regexp_replace(regexp_replace(replace(x, ' {w} ', ' '), '^{w} ', ''), ' {w}$', '')" for w in text.STOP_WORDS]
ADDRESS_STEPS = [s for first, *others in text.ADDRESS_WORDS for w in others for s in (f"replace(x, ' {w} ', ' {first} ')", f"CASE WHEN starts_with(x, '{w} ') THEN replace(x, '{w} ', '{first} ') ELSE x END", f"CASE WHEN ends_with(x, ' {w}') THEN replace(x, ' {w}', ' {first}') ELSE x END")]


@query(f"SELECT id, {sql_normal('name')} AS name_clean, {sql_without(sql_normal('name', False), ' 0123456789')} AS city_clean FROM ({NAME})")
def clean_text_st(spark: SparkSession, d: str) -> DataFrame:
    return named_documents(spark, d).select("id", text.normal(F.col("name")).alias("name_clean"), text.city_letters(text.normal(F.col("name"), spaces=False)).alias("city_clean"))


@query(in_steps(f"SELECT id, {sql_normal('name')} AS x FROM ({NAME})", STOP_STEPS, "id", "name_clean"))
def remove_stop_words(spark: SparkSession, d: str) -> DataFrame:
    return named_documents(spark, d).select("id", text.without_stop_words(text.normal(F.col("name"))).alias("name_clean"))


@query(in_steps(f"SELECT id, {sql_replaced('x', [(w, w[0]) for w in text.ORDINALS])} AS x FROM (SELECT doc_id AS id, lower({sql_plain('left(text, 76)')}) || ' 4th street' AS x FROM documents)", ADDRESS_STEPS, "id", "address_clean"))
def clean_ordinals_address(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lower(text.plain(F.col("name"))), F.lit(" 4th street"))
    return named_documents(spark, d).select("id", text.address(text.without_ordinals(raw)).alias("address_clean"))


@query(
    f"""SELECT id, CASE WHEN regexp_matches(bare, '^[\\x00-\\x7F]*$') THEN 1 WHEN regexp_matches({sql_without('bare', text.WESTERN_LETTERS)}, '^[\\x00-\\x7F]*$') THEN 2 ELSE 3 END AS lang
    FROM (SELECT id, replace({sql_without('lower(name)', text.EXOTIC_SYMBOLS)}, chr(10), ' ') AS bare FROM ({NAME}))"""
)
def language_class(spark: SparkSession, d: str) -> DataFrame:
    return named_documents(spark, d).select("id", text.language_class(F.col("name")).alias("lang"))


@query(
    in_steps(
        f"SELECT id, regexp_replace({sql_plain('name')}, '^[tT][hH][eE]', '') AS x FROM ({NAME})",
        [*STOP_STEPS, sql_replaced("x", [(w, w[0]) for w in text.ORDINALS]), "lower(list_aggregate(list_concat(list_transform(list_filter(string_split(x, ' '), lambda w: length(w) >= 2), lambda w: list_aggregate(list_concat(regexp_extract_all(w, '^[a-z]|[A-Z]'), ['']), 'string_agg', '')), ['']), 'string_agg', ''))"],
        "id",
        "initials",
    )
)
def caps_initials(spark: SparkSession, d: str) -> DataFrame:
    return named_documents(spark, d).select("id", text.initials(F.col("name")).alias("initials"))


@query(
    f"""SELECT id, name, CASE WHEN i > 0 AND j > i + 1 AND j - i < 10 AND length(name) - (j - i) > 9 AND inner_text = upper(inner_text)
    THEN left(name, CAST(i - 1 AS BIGINT)) || substring(name, j + 1) ELSE name END AS shorter
    FROM (SELECT *, {sql_without('substring(name, i + 1, greatest(j - i - 1, 0))', text.INNER_SYMBOLS)} AS inner_text FROM (
      SELECT p_partkey AS id, name, instr(name, '(') AS i, instr(name, ')') AS j FROM (
        SELECT p_partkey, p_name || ' (' || CASE WHEN p_size % 2 = 0 THEN upper(left(p_type, 3)) ELSE lower(p_type) END || ') and more' AS name FROM part)))"""
)
def bracketed_abbreviations(spark: SparkSession, d: str) -> DataFrame:
    inner = F.when(F.col("size") % 2 == 0, F.upper(F.left("category", F.lit(3)))).otherwise(F.lower("category"))
    name = F.concat("name", F.lit(" ("), inner, F.lit(") and more"))
    return parts(spark, d).select("id", name.alias("name")).select("id", "name", text.without_abbreviation(F.col("name")).alias("shorter"))


@query(
    """SELECT id, CASE WHEN digits IN ('000000000', '999999999') THEN '' ELSE digits END AS phone
    FROM (SELECT doc_id AS id, substring(lpad(right(regexp_replace(text, '[^0-9]', '', 'g'), 10), 10, '0'), 2, 9) AS digits FROM documents)"""
)
def phone_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.phone(F.col("text")).alias("phone"))


@query(in_steps(f"SELECT page_id AS id, {sql_normal('url', False)} AS x FROM pages", [*[f"regexp_replace(x, '^{p}', '')" for p in text.URL_PREFIXES], "left(x, 129)"], "id", "url"))
def url_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), text.url(F.col("url")).alias("url"))


def _classes(columns: list[str]) -> str:
    rules = [(c, n, words) for c in columns for n, words in KEYWORD_CLASSES.items()]
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({c}, {quoted(w)})' for w in words)} THEN {n}" for c, n, words in reversed(rules)) + " ELSE 0 END"


@query(f"SELECT p_partkey AS id, {_classes(['p_type', 'p_name'])} AS cat2, CASE " + " ".join(f"WHEN list_has_any(string_split(p_name, ' '), {list(w)}) THEN '{n}'" for n, w in CATEGORY_WORDS.items()) + " ELSE '' END AS filled FROM part")
def category_keyword_class(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).select("id", text.keyword_class([F.col("category"), F.col("name")], KEYWORD_CLASSES).alias("cat2"), text.first_category(F.col("name"), CATEGORY_WORDS).alias("filled"))


@query(
    """SELECT id, CASE WHEN list IN ('', 'nan') THEN -1 ELSE coalesce(list_filter(list_transform(string_split(lower(list), ','), lambda c:
      CASE trim(regexp_replace(lower(c), '[^a-zA-Z]+', ' ', 'g')) WHEN 'economy' THEN 1 WHEN 'promo' THEN 1 WHEN 'standard' THEN 2 WHEN 'medium' THEN 2 WHEN 'large' THEN 3 END), lambda n: n IS NOT NULL)[1], 0) END AS category_simpl
    FROM (SELECT p_partkey AS id, CASE WHEN p_size = 1 THEN '' WHEN p_size % 3 = 0 THEN p_name || ',' || p_type ELSE p_type END AS list FROM part)"""
)
def category_simplify(spark: SparkSession, d: str) -> DataFrame:
    labels = F.when(F.col("size") == 1, "").when(F.col("size") % 3 == 0, F.concat_ws(",", "name", "category")).otherwise(F.col("category"))
    return parts(spark, d).select("id", text.category_group(labels, CATEGORY_GROUPS).alias("category_simpl"))


@query(
    f"""SELECT p_partkey AS id, {sql_replaced('p_name', SPELLINGS.items())} AS spelled, CASE p_name {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES.items())} ELSE p_name END AS canonical, n_name AS region_name
    FROM part JOIN nation ON n_nationkey = p_size % 25"""
)
def synonym_map(spark: SparkSession, d: str) -> DataFrame:
    aliases = spark.createDataFrame(list(ALIASES.items()), "name string, canonical string")
    nations = table(spark, d, "nation").select(F.col("n_nationkey"), F.col("n_name").alias("region_name"))
    found = parts(spark, d).join(F.broadcast(aliases), "name", "left")  # four rows
    return found.join(nations, F.col("size") % 25 == F.col("n_nationkey")).select("id", text.replaced(F.col("name"), SPELLINGS.items()).alias("spelled"), F.coalesce("canonical", "name").alias("canonical"), "region_name")


_STATES = [a for a, _ in text.STATE_SPELLINGS] + ["ca", "nan"]
_CITY = "x"
for _pass in CITY_PASSES:
    for _a, _b in _pass.items():
        _CITY = f"replace(replace('|' || {_CITY} || '|', '|{_a}|', '|{_b}|'), '|', '')"


@query(
    f"""SELECT id, CASE WHEN city = 'nan' THEN '' ELSE city END AS city, CASE state {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in text.STATE_SPELLINGS)} WHEN 'nan' THEN '' ELSE left(state, 33) END AS state,
    CASE WHEN id % 9 = 0 THEN '' ELSE replace(left(street, 99), 'street', 'str') END AS address, CASE WHEN id % 8 = 0 THEN '' ELSE replace(replace(left(labels, 68), 'aiport', 'airport'), 'terminal', 'airport') END AS categories
    FROM (SELECT id, replace(left({_CITY}, 38), 'gorod', '') AS city, {_STATES}[1 + id % {len(_STATES)}] AS state, repeat('street ' || x || ' ', CAST(1 + id % 12 AS BIGINT)) AS street, repeat('aiport, ' || x || ' terminal, ', CAST(1 + id % 5 AS BIGINT)) AS labels
      FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'nan' WHEN c_custkey % 7 = 1 THEN 'gorod' ELSE '' END || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE lower(replace(n_name, ' ', '')) END AS x FROM customer JOIN nation ON n_nationkey = c_nationkey))"""
)
def place_fixes(spark: SparkSession, d: str) -> DataFrame:
    """Cities mapped in two passes, states, addresses and categories with their fixes and lengths."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    i = F.col("c_custkey")
    bare = F.lower(F.replace("n_name", F.lit(" "), F.lit("")))
    rows = rows.select(i.alias("id"), F.when(i % 7 == 0, "nan").when(i % 7 == 1, F.concat(F.lit("gorod"), bare)).otherwise(bare).alias("x"))
    i, x = F.col("id"), F.col("x")
    names = F.array(*[F.lit(s) for s in _STATES])
    street = F.when(i % 9 == 0, "nan").otherwise(F.repeat(F.concat(F.lit("street "), x, F.lit(" ")), (1 + i % 12).cast("int")))
    labels = F.when(i % 8 == 0, "nan").otherwise(F.repeat(F.concat(F.lit("aiport, "), x, F.lit(" terminal, ")), (1 + i % 5).cast("int")))
    return rows.select("id", text.city(x, *CITY_PASSES).alias("city"), text.state(F.get(names, (i % len(_STATES)).cast("int"))).alias("state"), text.short_street(street).alias("address"), text.categories(labels).alias("categories"))


BRAND_ROWS = ", ".join(f"({-i - 1}, {quoted(b)})" for i, b in enumerate(BRANDS))
SEVEN = sql_replaced("x", [(s + a, "seven eleven" + b) for s in text.SEVEN_ELEVEN for a, b in (("#", " "), (" ", " "), ("", ""))])


@query(in_steps(f"SELECT doc_id AS id, lower(left(text, 76)) AS x FROM documents UNION ALL SELECT * FROM (VALUES {BRAND_ROWS}) t(id, x)", [sql_without("x", text.MARKS), SEVEN, "replace(x, 'sea world', 'seaworld')", sql_replaced("x", [(s, "mac donald") for s in text.MC_DONALD]), sql_replaced("x", text.COMMON_SPELLINGS)], "id", "name"))
def brand_spelling_fixes(spark: SparkSession, d: str) -> DataFrame:
    rows = named_documents(spark, d).select("id", F.lower("name").alias("name"))
    rows = rows.unionByName(spark.createDataFrame([(-i - 1, b) for i, b in enumerate(BRANDS)], "id long, name string"))
    fixed = text.common_spellings(text.mac_donald(text.sea_world(text.seven_eleven(text.without_marks(F.col("name"))))))
    return rows.select("id", fixed.alias("name"))


@query(
    f"""SELECT id, CASE WHEN contains(x, 'walmart') THEN 'walmart' WHEN contains(x, 'carrefour') THEN 'carrefour' ELSE regexp_replace(x, '^the', '') END AS name
    FROM (SELECT doc_id AS id, replace(CASE WHEN doc_id % 50 = 0 THEN 'super walmart ' ELSE '' END || {sql_normal('left(text, 76)', False)}, 'center', '') AS x FROM documents)"""
)
def name_collapse_rules(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.when(F.col("id") % 50 == 0, "super walmart ").otherwise(""), text.normal(F.col("name"), spaces=False))
    return named_documents(spark, d).select("id", text.collapsed_name(name).alias("name"))


@query(
    in_steps(
        "SELECT doc_id AS id, lower(left(text, 76)) AS x FROM documents",
        ["CASE WHEN contains(x, 'the') THEN 'north' || replace(x, 'the', '') ELSE x END", "CASE WHEN contains(x, 'of') THEN replace(x, 'of', '') || 'building' ELSE x END", "replace(x, 'and', 'street')"],
        "id",
        "name",
    )
)
def ordered_word_translation(spark: SparkSession, d: str) -> DataFrame:
    return named_documents(spark, d).select("id", text.ordered_translation(F.lower("name"), WORD_TRANSLATIONS, ("north",), ("building",)).alias("name"))


@query(
    f"""SELECT doc_id AS id, array_to_string(list_transform(regexp_extract_all(trim(lower(left(text, 76))), '[\\p{{L}}\\p{{N}}_]+'), lambda w: CASE w {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in DICTIONARY.items())} ELSE w END), ' ') AS translated,
    array_to_string(list_transform(list_filter(string_split(left(text, 76), ' '), lambda w: length(w) >= 2), lambda w: trim(regexp_replace(w, '[^a-zA-Z]+', ' ', 'g'))), '|') AS tokens FROM documents"""
)
def word_by_word_translation(spark: SparkSession, d: str) -> DataFrame:
    return named_documents(spark, d).select("id", text.word_translation(F.col("name"), DICTIONARY).alias("translated"), F.array_join(text.tokens(F.col("name")), "|").alias("tokens"))


@query(
    """WITH d AS (SELECT doc_id AS id, list_sort(list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '^[0-9]+$'))) AS nums, coalesce(try_cast(left(regexp_replace(text, '[^0-9]', '', 'g'), 9) AS INT), 0) AS num, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents),
    p AS (SELECT a.id AS id_1, b.id AS id_2, a.num AS num_1, a.nums AS x, b.nums AS y, len(list_filter(a.nums, lambda n: list_contains(b.nums, n))) AS c FROM d a JOIN d b ON a.lang = b.lang AND b.rn = a.rn + 1)
    SELECT id_1, id_2, num_1, 2 * c - len(x) - len(y) AS nb_in_name, round(CASE WHEN len(x) + len(y) - c > 0 THEN (2 * c - len(x) - len(y)) / (len(x) + len(y) - c) ELSE 0 END, 6) AS ratio_in_name,
    CASE WHEN len(x) = 0 AND len(y) = 0 THEN 0 WHEN len(x) = 0 OR len(y) = 0 THEN -1 WHEN x = y THEN 3 WHEN list_has_all(y, x) OR list_has_all(x, y) THEN 2 WHEN list_has_any(x, y) THEN 1 ELSE -2 END AS num_in_name FROM p"""
)
def number_tokens_agreement_whole(spark: SparkSession, d: str) -> DataFrame:
    """number_tokens_agreement over whole texts."""
    from samewise.operators.blocking import sorted_neighbours
    from samewise.operators.features import number_features

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("text").alias("name"))
    pairs = sorted_neighbours(docs, "id", ["lang"], ["id"], 1, ["name"])
    return pairs.select("id_1", "id_2", text.digits_number(F.col("name_1")).alias("num_1"), *number_features("name"))


@query(
    """WITH d AS (SELECT doc_id AS id, left(text, 76) AS name, source, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents)
    SELECT a.id AS id_1, b.id AS id_2, CASE WHEN contains(lower(a.name), lower(b.name)) OR contains(lower(b.name), lower(a.name)) THEN 1 ELSE 0 END AS name_included, CASE WHEN lower(a.source) = lower(b.source) THEN 1 ELSE 0 END AS same_source,
    CASE WHEN length(a.name) >= 5 AND left(a.name, 5) = left(b.name, 5) THEN 1 ELSE 0 END AS name_m5, CASE WHEN length(a.name) >= 10 AND left(a.name, 10) = left(b.name, 10) THEN 1 ELSE 0 END AS name_m10,
    CASE WHEN coalesce(a.name, '') = '' THEN 1 ELSE 0 END + CASE WHEN coalesce(b.name, '') = '' THEN 1 ELSE 0 END AS name_na
    FROM d a JOIN d b ON a.lang = b.lang AND b.rn = a.rn + 1"""
)
def prefix_match_missing_flags(spark: SparkSession, d: str) -> DataFrame:
    from samewise.operators.blocking import sorted_neighbours

    p = sorted_neighbours(named_documents(spark, d), "id", ["lang"], ["id"], 1, ["name", "source"])
    a, b = F.col("name_1"), F.col("name_2")
    return p.select("id_1", "id_2", similarity.included(a, b).alias("name_included"), similarity.equal(F.col("source_1"), F.col("source_2")).alias("same_source"), similarity.same_beginning(a, b, 5).alias("name_m5"), similarity.same_beginning(a, b, 10).alias("name_m10"), similarity.missing(a, b).alias("name_na"))
