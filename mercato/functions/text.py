"""Text functions of the catalog, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower-case letters whose accents are dropped.
ACCENTED, PLAIN = "áàäéèëíìïóòöúùüñ", "aaaeeeiiiooouuun"
# Words that say nothing about which product it is.
STOP_WORDS = """negro negra blanco blanca azul rojo roja verde gris beige naranja amarillo violeta marron celeste rosa
plateado dorado tostado crudo navy khaki oliva militar ivory offwhite off white black grey gray red blue
hombre mujer masculino femenino unisex dama caballero xs xxs s m l xl xxl xxxl unico talle talla size
nuevo nueva original importado coleccion edicion temporada de la el los las con para en y a e""".split()
# Spellings of sizes.
SIZES = {
    "extra small": "XS", "extrasmall": "XS", "xxs": "XXS", "small": "S", "chico": "S", "ch": "S", "medium": "M", "mediano": "M", "med": "M",
    "large": "L", "grande": "L", "gr": "L", "extra large": "XL", "extralarge": "XL", "xxlarge": "XXL", "extra extra large": "XXL",
    "xxxlarge": "XXXL", "3xl": "XXXL", "3 xl": "XXXL", "talle unico": "Único", "unico": "Único", "unique": "Único", "default title": "",
}
SIZE_ORDER = ["XS", "S", "M", "L", "XL", "XXL", "XXXL", "3XL", "4XL"]
SEPARATORS = r"[\s\-_/.,()]+"


def strip_accents(text: Column) -> Column:
    """Drops the accents of lower-case letters."""
    return F.translate(text, ACCENTED, PLAIN)


def fold(text: Column) -> Column:
    return strip_accents(F.lower(F.coalesce(text, F.lit(""))))


def site_key(site: Column) -> Column:
    return F.regexp_replace(F.lower(site), "[^a-z0-9]", "")


def product_key(url: Column) -> Column:
    """16 hexadecimal digits that stand for a URL."""
    return F.substring(F.md5(url), 1, 16)


def blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def image_url(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)


def sizes(raw: Column) -> Column:
    """Normalised sizes without repeats, in order of first mention."""
    table = F.create_map(*[F.lit(x) for pair in SIZES.items() for x in pair])

    def one(x: Column) -> Column:
        clean = F.regexp_replace(F.upper(F.trim(x)), "[^A-Z0-9./]", "")
        return F.coalesce(F.element_at(table, F.lower(F.trim(x))), F.when(F.length(clean) <= 6, clean).otherwise(""))

    return F.array_distinct(F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda x: one(F.coalesce(x, F.lit("")))), lambda x: F.trim(x) != ""))


def size_rank(size: Column) -> Column:
    """Sort key: letter sizes in order, then numbers ascending, then the rest without case."""
    known = F.array_position(F.array(*map(F.lit, SIZE_ORDER)), F.upper(size))
    number = F.when(size.rlike(r"^\d+(\.\d+)?$"), size.cast("double"))
    return F.struct(
        F.when(known > 0, 0).when(number.isNotNull(), 1).otherwise(2).alias("kind"),
        F.when(known > 0, known.cast("double")).otherwise(F.coalesce(number, F.lit(0.0))).alias("value"),
        F.lower(size).alias("text"),
        size.alias("size"),
    )


def significant_words(text: Column) -> Column:
    """Words of three letters or more that tell products apart, in order, repeats included."""
    words = F.transform(F.split(fold(text), SEPARATORS), lambda t: F.regexp_replace(t, "[^a-z0-9]", ""))
    return F.filter(words, lambda t: (F.length(t) >= 3) & ~t.isin(STOP_WORDS) & ~t.rlike(r"^\d{1,2}$"))


def identity(category: Column, brand: Column, name: Column) -> Column:
    """Letters of the category and the first five significant words of brand and name."""
    text = F.trim(F.concat(F.trim(F.coalesce(brand, F.lit(""))), F.lit(" "), F.trim(F.coalesce(name, F.lit("")))))
    letters = F.regexp_replace(F.trim(F.lower(F.coalesce(category, F.lit("")))), "[^a-z]", "")
    return F.concat(letters, F.lit("_"), F.array_join(F.slice(significant_words(text), 1, 5), "_"))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def matches_any(text: Column, words: list[str]) -> Column:
    """Whether a padded, folded text contains one of the keywords."""
    padded = F.concat(F.lit(" "), fold(text), F.lit(" "))
    return reduce(lambda x, y: x | y, [padded.contains(w) for w in words], F.lit(False))


# What a search query leaves out, in this order: labelled sizes, sizes, short numbers, colours, gender, descriptors, long codes.
UNSEARCHED = [
    r"\b(talle|talla|size)[:\s]*\S+",
    r"\b(xs|xxs|s|m|l|xl|xxl|xxxl|3xl)\b",
    r"\b\d{1,2}([,.]5)?\b",
    r"\b(negro|negra|blanco|blanca|azul|rojo|roja|verde|gris|beige|naranja|amarillo|violeta|marron|celeste|rosa|plateado|dorado|tostado|crudo|ivory|navy|khaki|oliva|militar)\b",
    r"\b(de hombre|de mujer|para hombre|para mujer|masculino|femenino|unisex|hombre|mujer)\b",
    r"\b(original|importado|nuevo|nueva|edicion|coleccion|temporada|primavera|verano|invierno|fw|ss)\b",
    r"\b\d{5,}\b",
]


def search_query(name: Column, longest: int = 60) -> Column:
    """A name as a search query: no sizes, colours, gender, descriptors, codes or punctuation; cut at a word boundary, its case kept; the name's beginning if nothing is left."""
    text = F.coalesce(name, F.lit(""))
    for pattern in UNSEARCHED:
        text = F.regexp_replace(text, "(?i)" + pattern, "")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"[,/|()\[\]]+", " "), r"\s{2,}", " "))
    whole = F.regexp_extract(text, rf"^(.{{0,{longest}}}) ", 1)
    short = F.trim(F.when(F.length(whole) > 15, whole).otherwise(F.substring(text, 1, longest)))
    return F.when(blank(text), F.substring(F.coalesce(name, F.lit("")), 1, 40)).when(F.length(text) > longest, short).otherwise(text)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def domain(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(https?://[^/?#]+)", 1)
