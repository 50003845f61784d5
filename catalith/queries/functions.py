"""Scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import identity as I
from ..functions import price as P
from ..functions import text as T
from ..functions import urls as U
from ..operators.resolve import per_distinct
from ..registry import query
from ..sources.tables import raw, view
from .reading import normal


@query("normalize_text", f"SELECT product_id, {normal('title')} AS text FROM products")
def normalize_text(spark, d):
    return view(spark, d, "products").select("product_id", T.identity_text(F.col("title")).alias("text"))


@query("normalize_documents", f"SELECT doc_id, {normal('text')} AS text FROM documents")
def normalize_documents(spark, d):
    return raw(spark, d, "documents").select("doc_id", T.identity_text(F.col("text")).alias("text"))


_SLUG = "regexp_replace(regexp_replace(lower(translate({0}, '" + C.ACCENTED + "', '" + C.PLAIN + "')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query("slugs", f"SELECT product_id, {_SLUG.format('title')} AS slug FROM products")
def slugs(spark, d):
    return view(spark, d, "products").select("product_id", T.slug(F.col("title")).alias("slug"))


@query("dedupe_tokens", f"""SELECT product_id, array_to_string(list_filter(string_split({normal('title')}, ' '), lambda w: length(w) > 1 AND NOT list_contains({C.DEDUPE_STOPWORDS}, w)), ' ') AS tokens FROM products""")
def dedupe_tokens(spark, d):
    return view(spark, d, "products").select("product_id", F.array_join(T.dedupe_tokens(F.col("title")), " ").alias("tokens"))


def _case(rules, text, default):
    whens = " ".join(f"WHEN {' OR '.join(f"contains({text}, '{t}')" for t in terms)} THEN '{name}'" for name, terms in rules)
    return f"CASE {whens} ELSE '{default}' END"


@query("category_inference", f"SELECT product_id, {_case(C.CATEGORY_KEYWORDS, 'lower(title)', 'perifericos')} AS listed, {_case(C.DETAIL_KEYWORDS, 'lower(title)', 'perifericos')} AS detailed FROM products")
def category_inference(spark, d):
    return view(spark, d, "products").select("product_id", T.infer_category(F.col("title")).alias("listed"), T.infer_detail_category(F.col("title")).alias("detailed"))


def _group(text, pattern):
    return rf"nullif(regexp_replace(regexp_extract({text}, '\b({pattern})\b', 1), '\s+', '', 'g'), '')"


@query(
    "fingerprints",
    f"SELECT product_id, {_group(normal('title'), C.FINGERPRINT_BRAND)} AS brand, {_group(normal('title'), C.FINGERPRINT_CHIP)} AS chip, {_group(normal('title'), r'\d{1,2}\s*gb')} AS memory FROM products",
)
def fingerprints(spark, d):
    return view(spark, d, "products").select("product_id", I.fingerprint(T.identity_text(F.col("title"))).alias("f")).select("product_id", "f.brand", "f.chip", "f.memory")


@query(
    "cpu_keys",
    rf"SELECT product_id, concat('cpu:ryzen', regexp_extract({normal('title')}, '\bryzen\s*([3579])\s*(\d{{3,5}}(?:x3d|gt|ge|xt|x|g|f)?)\b', 1), regexp_extract({normal('title')}, '\bryzen\s*([3579])\s*(\d{{3,5}}(?:x3d|gt|ge|xt|x|g|f)?)\b', 2)) AS cpu FROM products WHERE regexp_matches({normal('title')}, '\bryzen\s*([3579])\s*(\d{{3,5}}(?:x3d|gt|ge|xt|x|g|f)?)\b')",
)
def cpu_keys(spark, d):
    return view(spark, d, "products").select("product_id", I.cpu_key(T.identity_text(F.col("title"))).alias("cpu")).filter("cpu is not null")


def _variant(text, variants):
    whens = " ".join(rf"WHEN regexp_matches({text}, '\b{v.replace(' ', r'\s+')}\b') THEN '{v.replace(' ', '')}'" for v in variants)
    return f"CASE {whens} END"


@query(
    "gpu_keys",
    f"""WITH t AS (SELECT product_id, {normal('title')} AS x FROM products)
SELECT product_id, concat_ws(':', 'gpu', {_group('x', C.GPU_CHIP)}, coalesce({_group('x', r'\d{1,2}\s*gb')}, 'na'), coalesce({_group('x', C.BRANDS)}, 'na'), coalesce({_variant('x', C.GPU_VARIANTS)}, 'base')) AS gpu
FROM t WHERE {_group('x', C.GPU_CHIP)} IS NOT NULL""",
)
def gpu_keys(spark, d):
    return view(spark, d, "products").select("product_id", I.gpu_key(T.identity_text(F.col("title"))).alias("gpu")).filter("gpu is not null")


@query(
    "motherboard_keys",
    rf"""WITH t AS (SELECT product_id, {normal('title')} AS x FROM products WHERE hw_category = 'motherboards')
SELECT product_id, concat_ws(':', 'mb', coalesce({_group('x', C.BRANDS)}, 'na'), {_group('x', '[abhxz]\\d{3}[a-z]{0,2}'.replace(chr(92) * 2, chr(92)))}, coalesce({_group('x', r'am4|am5|lga\s*\d{3,4}')}, 'na'), coalesce({_variant('x', C.MB_VARIANTS)}, 'base'), CASE WHEN regexp_matches(x, '\bwifi\b') THEN 'wifi' ELSE 'nowifi' END) AS board FROM t""",
)
def motherboard_keys(spark, d):
    boards = view(spark, d, "products").filter("hw_category = 'motherboards'")
    return boards.select("product_id", I.motherboard_key(T.identity_text(F.col("title"))).alias("board"))


_T = normal("title")
_FIND = lambda pattern: f"regexp_extract({_T}, '{pattern}')"
_TITLE_KEY = f"""CASE WHEN title LIKE 'Combo%' THEN concat('bundle:', {_SLUG.format("title")}) WHEN title LIKE 'Micro%' THEN concat('cpu:', replace({_FIND("ryzen [0-9] [0-9]+x?")}, ' ', ''))
  WHEN title LIKE 'Placa%' THEN concat_ws(':', 'gpu', replace({_FIND("rtx [0-9]+( ti)?")}, ' ', ''), '8gb', {_FIND("msi|asus|zotac")}, {_FIND("shadow|dual")})
  WHEN title LIKE 'Motherboard%' THEN concat_ws(':', 'mb:gigabyte', {_FIND("b[0-9]+m")}, 'am5', {_FIND("aorus|ds3h")}, CASE WHEN {_T} LIKE '%wifi%' THEN 'wifi' ELSE 'nowifi' END)
  WHEN title LIKE 'Mouse%' THEN concat('generic:logitech:mouse:', {_FIND("g[0-9]+")}, CASE WHEN {_T} LIKE '%hero%' THEN concat('-', {_FIND("g[0-9]+")}, '-hero') ELSE '' END)
  ELSE concat('generic:na:other:ddr4-', {_FIND("[0-9]+gb")}) END"""
_TITLE_FAMILY = f"""CASE WHEN title LIKE 'Combo%' THEN NULL WHEN title LIKE 'Micro%' THEN concat('cpu-family:ryzen', replace(regexp_extract({_T}, 'ryzen ([0-9] [0-9]+)', 1), ' ', '-'))
  WHEN title LIKE 'Placa%' THEN concat('gpu-family:', replace({_FIND("rtx [0-9]+( ti)?")}, ' ', '')) WHEN title LIKE 'Motherboard%' THEN concat_ws(':', 'mb-family:gigabyte', {_FIND("b[0-9]+m")}, 'am5')
  WHEN title LIKE 'Mouse%' THEN concat('generic-family:logitech:mouse:', {_FIND("g[0-9]+")}) ELSE concat('generic-family:na:other:ddr4-', {_FIND("[0-9]+gb")}) END"""
_TITLE_SHORT = f"""upper(CASE WHEN title LIKE 'Combo%' THEN concat('combo ', {_FIND("[0-9]+")}, ' combo pc rtx ryzen') WHEN title LIKE 'Micro%' THEN {_FIND("amd.*")} WHEN title LIKE 'Placa%' THEN {_FIND("(msi|asus|zotac).*")}
  WHEN title LIKE 'Motherboard%' THEN concat('gigabyte am5 ', {_FIND("b[0-9]+m")}) WHEN title LIKE 'Mouse%' THEN concat_ws(' ', {_FIND("g[0-9]+")}, CASE WHEN {_T} LIKE '%hero%' THEN 'hero' END, 'logitech mouse optico rgb')
  ELSE concat('kingston ', {_FIND("[0-9]+gb")}) END)"""
_HASHED = "list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(string_split(concat(hw_category, '|', canonical_key), ''), lambda c: CAST(ascii(c) AS HUGEINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
_BASE36 = "ltrim(array_to_string(list_transform([6, 5, 4, 3, 2, 1, 0], lambda k: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((hashed // CAST(pow(36, k) AS HUGEINT)) % 36 + 1 AS BIGINT), 1)), ''), '0')"


@query(
    "canonical_keys",
    f"""WITH k AS (SELECT product_id, title, hw_category, concat(hw_category, '::', {_TITLE_KEY}) AS canonical_key, {_TITLE_FAMILY} AS family_key, {_TITLE_SHORT} AS heuristic_title, substr({_SLUG.format("title")}, 1, 48) AS readable FROM products),
h AS (SELECT *, {_HASHED} AS hashed FROM k)
SELECT product_id, canonical_key, family_key, CASE WHEN title LIKE 'Combo%' THEN concat(hw_category, '::bundle') ELSE canonical_key END AS variant_key, concat_ws('-', 'agrupado', hw_category, readable, {_BASE36}) AS grouped_id, heuristic_title FROM h""",
)
def canonical_keys(spark, d):
    """Canonical, family and variant keys and the grouped id of every title."""

    def keyed(titles):
        titles = titles.withColumn("s", I.identity_source(F.col("title"), F.lit(None).cast("string")))
        c, s = F.col("hw_category"), F.col("s")
        return titles.withColumn("canonical_key", I.canonical_key(c, s)).select(
            "title", "hw_category", "canonical_key", I.family_key(c, s).alias("family_key"), I.variant_key(c, s).alias("variant_key"),
            I.grouped_id(c, F.col("title"), F.col("canonical_key")).alias("grouped_id"), I.heuristic_title(F.col("title")).alias("heuristic_title"),
        )

    products = view(spark, d, "products").select("product_id", "title", "hw_category")
    return per_distinct(products, ["title", "hw_category"], keyed).drop("title", "hw_category")


@query("bundle_titles", f"SELECT product_id FROM products WHERE contains({normal('title')}, '+') OR " + " OR ".join(f"contains(concat(' ', {normal('title')}, ' '), ' {t} ')" for t in C.BUNDLE_TERMS))
def bundle_titles(spark, d):
    return view(spark, d, "products").filter(T.is_bundle(F.col("title"))).select("product_id")


@query(
    "fnv_ids",
    """WITH RECURSIVE t AS (SELECT product_id, concat(hw_category, '|', lower(brand)) AS s FROM products),
h AS (SELECT product_id, s, 0 AS i, 2166136261::BIGINT AS v FROM t UNION ALL SELECT product_id, s, i + 1, ((xor(v, ascii(substr(s, i + 1, 1))::BIGINT)::HUGEINT * 16777619) % 4294967296)::BIGINT FROM h WHERE i < length(s))
SELECT product_id, v AS hash FROM h WHERE i = length(s)""",
)
def fnv_ids(spark, d):
    """The hash behind a grouped id, back from base 36 to a number."""
    text = F.concat("hw_category", F.lit("|"), F.lower("brand"))
    return view(spark, d, "products").select("product_id", F.conv(F.upper(I.fnv1a36(text)), 36, 10).cast("long").alias("hash"))


_SCORE_WORDS = [f"contains({normal('title')}, '{w}')" for w in ("ryzen", "rtx", "3060")]
_MATCHED = "(" + " + ".join(f"{w}::INT" for w in _SCORE_WORDS) + ")"


@query(
    "relevance_scores",
    f"""SELECT product_id, CAST({_MATCHED} * 25 + CASE WHEN {_MATCHED} = 3 THEN 120 ELSE 0 END + CASE WHEN contains({normal('title')}, 'ryzen rtx 3060') THEN 120 ELSE 0 END
  + CASE WHEN hw_category = 'procesadores' THEN 30 ELSE 0 END
  + CASE WHEN contains({normal('title')}, '+') OR {" OR ".join(f"contains(concat(' ', {normal('title')}, ' '), ' {t} ')" for t in C.BUNDLE_TERMS)} THEN -120 ELSE 0 END
  + CASE WHEN retail > 0 THEN greatest(0, 20 - floor(retail / 200000)) ELSE 0 END AS BIGINT) AS score FROM products""",
)
def relevance_scores(spark, d):
    score = P.relevance(F.col("title"), F.col("hw_category"), F.col("retail"), "Ryzen RTX 3060", "procesadores")
    return view(spark, d, "products").select("product_id", score.alias("score"))


_R = normal("title")
_BUNDLES = f"(contains({_R}, '+') OR " + " OR ".join(f"contains(concat(' ', {_R}, ' '), ' {t} ')" for t in C.BUNDLE_TERMS) + ")"
_HITS = " + ".join(f"({_R} LIKE '%{w}%')::INT" for w in ("rtx", "3060", "shadow"))


@query(
    "relevance_ranking",
    f"""WITH s AS (SELECT product_id, retail, {_BUNDLES} AS bundle, {_HITS} AS n, {_R} LIKE '%rtx 3060 shadow%' AS whole FROM products)
SELECT product_id, CAST(n * {C.SCORE_WORD} + (n = 3)::INT * {C.SCORE_ALL} + whole::INT * {C.SCORE_PHRASE} + bundle::INT * {C.SCORE_BUNDLE} + CASE WHEN retail > 0 THEN greatest(0, {C.SCORE_PRICE} - floor(retail / {C.PRICE_STEP})) ELSE 0 END AS BIGINT) AS score, bundle
FROM s ORDER BY bundle, score DESC, retail, product_id LIMIT {C.READ_LIMIT}""",
)
def relevance_ranking(spark, d):
    """Products in order of relevance: bundles last, then score, then price."""
    scored = view(spark, d, "products").withColumns({
        "score": P.relevance(F.col("title"), F.col("hw_category"), F.col("retail"), "rtx 3060 shadow"), "bundle": T.is_bundle(F.col("title"))
    })
    return scored.orderBy("bundle", F.col("score").desc(), "retail", "product_id").limit(C.READ_LIMIT).select("product_id", "score", "bundle")


@query(
    "price_texts",
    r"""SELECT product_id, retail + 99 AS price FROM products""",
)
def price_texts(spark, d):
    """Prices written in local notation and parsed back."""
    value = F.col("retail") + 99
    text = F.concat(F.lit("Precio final: "), P.format_price(value), F.lit(",40"))
    return view(spark, d, "products").select("product_id", P.parse_price(text).alias("price"))


@query("xml_escapes", """SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS xml FROM pages""")
def xml_escapes(spark, d):
    return raw(spark, d, "pages").select("page_id", T.xml_escape(F.col("html")).alias("xml"))


@query("decoded_entities", """SELECT page_id, replace(replace(replace(replace(replace(replace(replace(html, '&quot;', '"'), '&#34;', '"'), '&#39;', ''''), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS text FROM pages""")
def decoded_entities(spark, d):
    return raw(spark, d, "pages").select("page_id", T.decode_entities(F.col("html")).alias("text"))


@query("mojibake_repair", "SELECT product_id, title AS text FROM products")
def mojibake_repair(spark, d):
    """Titles whose UTF-8 bytes were read as Latin-1, repaired."""
    broken = F.decode(F.encode("title", "UTF-8"), "ISO-8859-1")
    return view(spark, d, "products").select("product_id", T.repair_display_text(broken).alias("text"))


@query(
    "url_keys",
    r"""WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), q AS (SELECT page_id, regexp_replace(u, '\?.*$', '') AS base, list_filter(string_split(CASE WHEN contains(u, '?') THEN regexp_replace(u, '^[^?]*\?', '') ELSE '' END, '&'),
  lambda x: x <> '' AND NOT list_contains(['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'ref'], split_part(x, '=', 1))) AS a FROM p)
SELECT page_id, CASE WHEN len(a) > 0 THEN concat(base, '?', array_to_string(a, '&')) ELSE base END AS url FROM q""",
)
def url_keys(spark, d):
    return raw(spark, d, "pages").select("page_id", U.url_key(F.col("url")).alias("url"))


_NUMBERED = r"CASE page_id % 4 WHEN 0 THEN concat(split_part(split_part(url, '#', 1), '?', 1), '/page/', CAST(page_id AS VARCHAR), '/') WHEN 1 THEN concat(split_part(url, '#', 1), '&paged=', CAST(page_id AS VARCHAR)) ELSE url END"


@query(
    "page_numbers",
    rf"""SELECT page_id, coalesce(TRY_CAST(nullif(regexp_extract(u, '[?&]page=(\d+)', 1), '') AS INT), CASE WHEN page_id > 0 AND contains(u, '?') THEN TRY_CAST(nullif(regexp_extract(u, '&paged=(\d+)', 1), '') AS INT) END,
  CASE WHEN page_id > 0 THEN TRY_CAST(nullif(regexp_extract(u, '/page/(\d+)/$', 1), '') AS INT) END, 1) AS page FROM (SELECT page_id, {_NUMBERED} AS u FROM pages)""",
)
def page_numbers(spark, d):
    """Numbers of pages from addresses in the forms that shops use."""
    n, plain = F.col("page_id").cast("string"), F.split_part("url", F.lit("#"), F.lit(1))
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.split_part(plain, F.lit("?"), F.lit(1)), F.lit("/page/"), n, F.lit("/"))).when(F.col("page_id") % 4 == 1, F.concat(plain, F.lit("&paged="), n)).otherwise(F.col("url"))
    return raw(spark, d, "pages").select("page_id", U.page_number(url).alias("page"))


@query("normalised_ids", r"SELECT page_id, trim(regexp_replace(lower(split_part(split_part(url, '://', 2), '?', 1)), '[\s_/]+', '-', 'g'), '-') AS id FROM pages")
def normalised_ids(spark, d):
    path = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1))
    return raw(spark, d, "pages").select("page_id", U.normal_id(path).alias("id"))


@query("content_signatures", "SELECT count(*) AS n, count(DISTINCT concat_ws('|', name, category, brand)) AS distinct_rows FROM products")
def content_signatures(spark, d):
    from ..operators.resolve import content_signature

    signed = view(spark, d, "products").select(content_signature([F.col("name"), F.col("category"), F.col("brand")]).alias("s"))
    return signed.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("distinct_rows"))


@query("relative_times", """SELECT event_id, CASE WHEN m < 60 THEN concat(CAST(m AS STRING), ' min') WHEN m < 1440 THEN concat(CAST(CAST(floor(m / 60) AS BIGINT) AS STRING), ' h') WHEN m < 10080 THEN concat(CAST(CAST(floor(m / 1440) AS BIGINT) AS STRING), ' d') ELSE strftime(ts, '%d/%m/%Y') END AS label
FROM (SELECT event_id, ts, CAST(floor(date_diff('second', ts, (SELECT max(ts) FROM requests)) / 60) AS BIGINT) AS m FROM requests)""")
def relative_times(spark, d):
    events = view(spark, d, "requests")
    return events.join(F.broadcast(events.agg(F.max("ts").alias("as_of")))).select("event_id", U.relative_time(F.col("ts"), F.col("as_of")).alias("label"))


@query("json_props", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark, d):
    return raw(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("truncated_text", r"SELECT doc_id, CASE WHEN length(t) <= 160 THEN t ELSE concat(regexp_replace(substr(t, 1, 160), '\s+\S*$', ''), '…') END AS text FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)")
def truncated_text(spark, d):
    return raw(spark, d, "documents").select("doc_id", U.truncate(F.col("text"), 160).alias("text"))
