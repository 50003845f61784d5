"""Identity keys of product titles: canonical, family and variant keys, fingerprints, grouped ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .text import first_group, heuristic_text, identity_text, is_bundle, let, slug


def identity_source(primary: Column, fallback: Column) -> Column:
    """Both normalised titles, or one if they are equal or the other is empty."""
    both = F.struct(*(identity_text(F.coalesce(c, F.lit(""))).alias(n) for c, n in ((primary, "a"), (fallback, "b"))))
    joined = lambda s: F.concat(s.a, F.lit(" "), s.b)
    return let(both, lambda s: F.when((s.a != "") & (s.b != "") & (s.a != s.b), joined(s)).when(s.a != "", s.a).otherwise(s.b))


def identity_fallback(brand: Column, model: Column, name: Column) -> Column:
    return F.concat_ws(" ", *(F.nullif(F.trim(c), F.lit("")) for c in (brand, model, name)))


def _or(value: Column, default: str) -> Column:
    return F.coalesce(value, F.lit(default))


def pick_variant(text: Column, variants: list[str]) -> Column:
    """The first variant of the list, not of the text, that stands as a word: one pass finds all, the list's order picks."""
    found = F.regexp_extract_all(text, F.lit(rf"\b({'|'.join(v.replace(' ', r'\s+') for v in variants)})\b"), F.lit(1))
    bare = F.transform(found, lambda v: F.regexp_replace(v, r"\s+", ""))
    return F.get(F.array_intersect(F.array(*(F.lit(v.replace(" ", "")) for v in variants)), bare), F.lit(0))


def family_token(text: Column) -> Column:
    return F.coalesce(*(F.when(text.rlike(p), F.lit(name)) for name, p in C.FAMILIES), F.lit("other"))


_RYZEN = r"\bryzen\s*([3579])\s*(\d{3,5}(?:x3d|gt|ge|xt|x|g|f)?)\b"
_INTEL = r"\bcore\s*i([3579])\s*(\d{4,5}[a-z]{0,2})\b"
_RYZEN_FAMILY = r"\bryzen\s*([3579])\s*(\d{3,5})[a-z0-9]*\b"
_INTEL_FAMILY = r"\bcore\s*i([3579])\s*(\d{4,5})[a-z]{0,2}\b"
_CHIPSET, _SOCKET, _MEMORY = r"[abhxz]\d{3}[a-z]{0,2}", r"am4|am5|lga\s*\d{3,4}", r"\d{1,2}\s*gb"


def _two(text: Column, pattern: str, prefix: str, between: str = "") -> Column:
    parts = [F.regexp_extract(text, pattern, k) for k in (1, 2)]
    return F.when(text.rlike(pattern), F.concat(F.lit(prefix), parts[0], F.lit(between), parts[1]))


def cpu_key(text: Column) -> Column:
    return F.coalesce(_two(text, _RYZEN, "cpu:ryzen"), _two(text, _INTEL, "cpu:corei"))


def gpu_key(text: Column) -> Column:
    chip = first_group(text, C.GPU_CHIP)
    parts = (_or(first_group(text, _MEMORY), "na"), _or(first_group(text, C.BRANDS), "na"), _or(pick_variant(text, C.GPU_VARIANTS), "base"))
    return F.when(chip.isNotNull(), F.concat_ws(":", F.lit("gpu"), chip, *parts))


def motherboard_key(text: Column) -> Column:
    chipset = first_group(text, _CHIPSET)
    wifi = F.when(text.rlike(r"\bwifi\b"), "wifi").otherwise("nowifi")
    head = (F.lit("mb"), _or(first_group(text, C.BRANDS), "na"), chipset, _or(first_group(text, _SOCKET), "na"))
    return F.when(chipset.isNotNull(), F.concat_ws(":", *head, _or(pick_variant(text, C.MB_VARIANTS), "base"), wifi))


def _model_like(token: Column) -> Column:
    return token.rlike("[a-z]") & token.rlike("[0-9]")


def _strong(token: Column) -> Column:
    """A token without a merged variant or one noisy suffix: the first of the list that leaves a model."""
    base = F.when(token.rlike(C.MERGED_VARIANT), F.regexp_extract(token, C.MERGED_VARIANT, 1)).otherwise(token)

    def trimmed(held: Column) -> Column:
        cuts = F.array(*(F.regexp_extract(held, f"^(.*){suffix}$", 1) for suffix in C.NOISY_SUFFIXES))
        good = F.filter(cuts, lambda c: (F.length(c) >= 3) & _model_like(c))
        return F.coalesce(F.get(good, F.lit(0)), held)

    return let(base, trimmed)


def strong_tokens(text: Column) -> Column:
    """Tokens that name a model: letters with digits, or a number with a unit."""
    tokens = F.transform(F.split(text, " "), _strong)
    keep = lambda t: (F.length(t) >= 2) & (_model_like(t) | t.rlike(r"^\d{2,3}(?:hz|w|wh|mm|ml|gb|tb)$"))
    return F.array_distinct(F.filter(tokens, keep))


def variant_tokens(text: Column, strong: Column) -> Column:
    """Variants that follow a strong token, then those merged into one."""
    tokens = F.split(text, " ")
    before = lambda i: F.when(i > 0, tokens[i - 1])
    apart = F.transform(
        tokens,
        lambda t, i: F.when(t.isin(*C.VARIANT_HINTS) & F.array_contains(strong, F.coalesce(before(i), F.lit(""))), F.concat(before(i), F.lit("-"), t)),
    )
    base, variant = (lambda t, k=k: F.regexp_extract(t, C.MERGED_VARIANT, k) for k in (1, 2))
    merged = F.transform(tokens, lambda t: F.when(F.array_contains(strong, base(t)), F.concat(base(t), F.lit("-"), variant(t))))
    return F.array_distinct(F.array_compact(F.concat(apart, merged)))


def soft_tokens(text: Column, brand: Column) -> Column:
    keep = lambda t: (F.length(t) >= 2) & (t != brand) & ~t.isin(*C.MODEL_STOPWORDS)
    return F.array_distinct(F.slice(F.filter(F.split(text, " "), keep), 1, 6))


def generic_key(text: Column, soft: bool, prefix: str = "generic", most: int = 4, variants: bool = True) -> Column:
    """Brand, family and model tokens; without model tokens other words stand in (``soft``)."""
    facts = F.struct(
        text.alias("text"),
        _or(first_group(text, C.BRANDS), "na").alias("brand"),
        family_token(text).alias("family"),
        F.slice(strong_tokens(text), 1, most).alias("strong"),
    )

    def key(s: Column) -> Column:
        head = F.concat(F.lit(f"{prefix}:"), s.brand, F.lit(":"), s.family, F.lit(":"))
        parts = F.concat(s.strong, F.slice(variant_tokens(s.text, s.strong), 1, 2)) if variants else s.strong
        found = F.when(F.size(s.strong) > 0, F.concat(head, F.array_join(parts, "-")))
        if not soft:
            return found
        loose = soft_tokens(s.text, s.brand)
        loose = loose if variants else F.slice(loose, 1, most)
        joined = lambda t: F.when(F.size(t) >= 2, F.concat(head, F.array_join(F.slice(t, 1, most), "-")))
        return F.coalesce(found, let(loose, joined))

    return let(facts, key)


def _by_category(category: Column, keys: dict[str, Column], other: Column) -> Column:
    out = None
    for name, key in keys.items():
        out = F.when(category == name, key) if out is None else out.when(category == name, key)
    return out.otherwise(other)


def _model(category: Column, text: Column) -> Column:
    nothing = F.lit(None).cast("string")
    return _by_category(category, {"procesadores": cpu_key(text), "tarjetas-graficas": gpu_key(text), "motherboards": motherboard_key(text)}, nothing)


def canonical_key(category: Column, source: Column) -> Column:
    """Key that offers of one product share; ``source`` is an ``identity_source``."""
    name = F.concat(F.lit("name:"), slug(source))
    bundle = F.when(is_bundle(source), F.concat(F.lit("bundle:"), slug(source)))
    key = F.when(source == "", F.lit("unknown")).otherwise(F.coalesce(bundle, _model(category, source), generic_key(source, True), name))
    return F.concat(category, F.lit("::"), key)


def exact_model(category: Column, title: Column) -> Column:
    """Model key of a title, null for bundles and titles without a model."""
    own = lambda text: F.coalesce(
        _model(category, text), F.when(~category.isin("procesadores", "tarjetas-graficas", "motherboards"), generic_key(text, False))
    )
    return F.when(~is_bundle(title), let(identity_text(title), own))


def family_key(category: Column, source: Column) -> Column:
    """Key of a product's family, null for bundles and where nothing names one."""
    chip, chipset = first_group(source, C.GPU_CHIP), first_group(source, _CHIPSET)
    cpu = F.coalesce(_two(source, _RYZEN_FAMILY, "cpu-family:ryzen", "-"), _two(source, _INTEL_FAMILY, "cpu-family:corei", "-"))
    gpu = F.when(chip.isNotNull(), F.concat(F.lit("gpu-family:"), chip))
    board = F.when(
        chipset.isNotNull(),
        F.concat_ws(":", F.lit("mb-family"), _or(first_group(source, C.BRANDS), "na"), chipset, _or(first_group(source, _SOCKET), "na")),
    )
    other = generic_key(source, True, "generic-family", 3, variants=False)
    own = _by_category(category, {"procesadores": cpu, "tarjetas-graficas": gpu, "motherboards": board}, other)
    return F.when((source != "") & ~is_bundle(source), own)


def variant_key(category: Column, source: Column) -> Column:
    name = F.concat(F.lit("name:"), slug(source))
    key = F.coalesce(exact_model(category, source), generic_key(source, True), name)
    return F.concat(category, F.lit("::"), F.when(source == "", "unknown").when(is_bundle(source), "bundle").otherwise(key))


def fingerprint(text: Column) -> Column:
    """Brand, chip and memory of a normalised name."""
    return F.struct(
        first_group(text, C.FINGERPRINT_BRAND).alias("brand"), first_group(text, C.FINGERPRINT_CHIP).alias("chip"), first_group(text, _MEMORY).alias("memory")
    )


def fnv1a36(text: Column) -> Column:
    """32-bit FNV-1a of an ASCII text, in base 36."""
    codes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("long"))
    step = lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(4294967295)
    hashed = F.aggregate(F.when(text != "", codes).otherwise(F.array().cast("array<bigint>")), F.lit(2166136261).cast("long"), step)
    return F.lower(F.conv(hashed.cast("string"), 10, 36))


def grouped_id(category: Column, title: Column, key: Column) -> Column:
    readable = F.coalesce(F.nullif(F.substring(slug(title), 1, 48), F.lit("")), F.lit("item"))
    return F.concat_ws("-", F.lit("agrupado"), category, readable, fnv1a36(F.concat(category, F.lit("|"), key)))


def heuristic_title(raw: Column) -> Column:
    """Upper-case title from its structured tokens, or its sorted distinct words; bundles say so."""

    def structured_tokens(flat: Column) -> Column:
        found = lambda p: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(flat, rf"\b({p})\b", 1), r"\s+", " ")), F.lit(""))
        memory = F.regexp_replace(F.coalesce(found(r"\d{1,2}\s*G(?:B)?"), F.lit("")), r"\D", "")
        padded = F.concat(F.lit(" "), flat, F.lit(" "))
        variants = F.array_compact(F.array(*(F.when(padded.contains(f" {v} "), F.lit(v)) for v in C.TITLE_VARIANTS)))
        sizes = F.array(
            F.when(memory != "", F.concat(memory, F.lit("GB"))), found(r"AM[45]|LGA\s*\d{3,4}"), found(r"[ABHXZ]\d{3}[A-Z]{0,2}"), found(r"\d+(?:\.\d+)?\s*(?:TB|GB)")
        )
        names = F.array(found(C.TITLE_BRANDS), F.coalesce(found(C.TITLE_GPU), found(C.TITLE_CPU)))
        return F.array_distinct(F.array_compact(F.concat(names, F.slice(variants, 1, 2), sizes)))

    def title(text: Column) -> Column:
        bundle = text.rlike(r"(^|\s)(COMBO|KIT|ARMADO|BUILD|PC)(\s|$)") | text.contains("+")
        loose = F.filter(F.split(text, " "), lambda t: (F.length(t) > 1) & ~t.isin(*C.TITLE_STOPWORDS, *C.TITLE_NOISE))
        compact = F.coalesce(F.nullif(F.array_join(F.array_sort(F.array_distinct(loose)), " "), F.lit("")), text)
        chosen = let(let(F.translate(text, "+", " "), structured_tokens), lambda t: F.when(F.size(t) >= 2, F.array_join(t, " ")).otherwise(compact))
        spaced = model_spacing(chosen)
        return F.when(text == "", raw).otherwise(F.concat(F.when(bundle, "COMBO ").otherwise(""), spaced))

    return let(heuristic_text(raw), title)


def model_spacing(text: Column) -> Column:
    """Spaces between a chip's name, number and suffix; ``8G`` as ``8GB`` (upper-case input)."""
    text = F.regexp_replace(text, r"\b(RTX|GTX|RX)\s*(\d{3,4})\s*(TI|SUPER|XT)\b", "$1 $2 $3")
    text = F.regexp_replace(text, r"\b(RTX|GTX|RX)\s*(\d{3,4})\b", "$1 $2")
    text = F.regexp_replace(text, r"\b(RYZEN)\s*([3579])\s*([0-9]{3,5}[A-Z0-9]{0,3})\b", "$1 $2 $3")
    text = F.regexp_replace(text, r"\b(CORE)\s*I([3579])\s*([0-9]{4,5}[A-Z]{0,2})\b", "$1 I$2 $3")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\b(\d{1,2})\s*G\b", "$1GB"), r"\s+", " "))
