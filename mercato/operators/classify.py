"""Category classifier on names: character n-grams, TF-IDF, logistic regression (Spark ML)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, NGram, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.operators.curation import TEXT_CONFIDENCE

LEAST_CONFIDENCE, OVERRIDE_CONFIDENCE, GENERIC_CONFIDENCE = 0.70, 0.82, 0.92


def training_rows(catalog: DataFrame, generic: list[str], least: int = 12) -> DataFrame:
    """``name, category`` of active rows with a telling category; classes with fewer than ``least`` rows are left out."""
    rows = catalog.where("active and trim(coalesce(name, '')) <> '' and trim(coalesce(category, '')) <> ''").where(~F.col("category").isin(generic))
    counts = rows.groupBy("category").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return rows.join(counts.select("category"), "category", "left_semi").select("url", "name", "category")


def fit(rows: DataFrame, features: int = 1 << 14, grams: tuple[int, ...] = (2, 3, 4)) -> PipelineModel:
    chars = RegexTokenizer(inputCol="name", outputCol="chars", pattern="", minTokenLength=1)
    ngrams = [NGram(n=n, inputCol="chars", outputCol=f"g{n}") for n in grams]
    together = SQLTransformer(statement=f"SELECT *, concat({', '.join(f'g{n}' for n in grams)}) AS grams FROM __THIS__")
    label = StringIndexer(inputCol="category", outputCol="label", handleInvalid="keep")
    model = Pipeline(stages=[label, chars, *ngrams, together, HashingTF(inputCol="grams", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="x"), LogisticRegression(featuresCol="x", labelCol="label", maxIter=30, regParam=1e-3)])
    return model.fit(rows)


def predict(model: PipelineModel, rows: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Adds guess and confidence; no guess below the least confidence."""
    back = IndexToString(inputCol="prediction", outputCol="guess", labels=model.stages[0].labels)
    scored = back.transform(model.transform(rows)).withColumn("confidence", F.array_max(vector_to_array("probability")))
    return scored.select(*rows.columns, F.when(F.col("confidence") >= least, F.col("guess")).alias("guess"), "confidence")


# Kinds of category that a guess never crosses; the first kind that lists a category counts.
KINDS = {
    "calzado": ["zapatilla", "zapatilla running", "zapatilla urbana", "zapatilla entrenamiento", "zapatilla skate", "sneaker", "botines", "botas", "ojotas", "borcego", "sandalia", "mocasin", "zapato", "pantufla"],
    "superior": ["remera", "musculosa", "camisa", "chomba", "casaca", "sweater", "buzo", "campera", "puffer", "piloto", "chaleco", "saco", "traje", "remeron", "corpino", "malla"],
    "inferior": ["jean", "pantalon", "jogging", "short", "bermuda", "calza", "baggy", "pollera", "shorts", "vestido", "enterito"],
    "interior": ["calzoncillos"],
    "accesorios": ["gorra", "gorro", "mochila", "bolso", "billetera", "rinonera", "riñonera", "medias", "cinturon", "bufanda", "guantes", "lentes", "tarjetero", "bandolera"],
    "tech": ["notebook", "monitor", "gabinete", "gpu", "ram", "teclado", "pc", "auricular", "mouse", "cpu", "cooling"],
    "nutricion": ["suplemento", "alimentos", "perfumes", "perfume", "perfumina"],
}
# The general category above a telling one, to which no guess takes it back.
PARENTS = {"zapatilla running": "zapatilla", "zapatilla urbana": "zapatilla", "zapatilla entrenamiento": "zapatilla", "zapatilla skate": "zapatilla", "sneaker": "zapatilla", "ojotas": "zapatilla", "botines": "calzado", "botas": "calzado", "jean": "pantalon", "jogging": "pantalon", "baggy": "pantalon"}
#: A category of several pieces, which no guess replaces.
SEVERAL_PIECES = "conjunto"


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def kind(category: Column) -> Column:
    """Kind of a category, null for one that stands in no kind."""
    return _looked_up({c: k for k, listed in KINDS.items() for c in listed}, F.translate(F.lower(category), "óáú", "oau"))


def overrides(category: Column, guess: Column, confidence: Column, generic: list[str], doubtful: Column | None = None) -> Column:
    """Whether a guess may replace a category.

    It must be sure enough, surer still unless the category is generic, of the same kind where both
    have one, and not the parent of the category. Sets of several pieces stay. Where ``doubtful`` is
    given, it must hold or the category be generic.
    """
    own = F.trim(F.coalesce(category, F.lit("")))
    is_generic = F.lower(own).isin(["", *[g.lower() for g in generic]])
    crosses = F.coalesce(kind(own) != kind(guess), F.lit(False))
    goes_back = F.coalesce(_looked_up(PARENTS, F.lower(own)) == F.lower(guess), F.lit(False))
    sure = (confidence >= OVERRIDE_CONFIDENCE) & (is_generic | (confidence >= GENERIC_CONFIDENCE))
    may = sure & (guess != own) & (F.lower(own) != SEVERAL_PIECES) & ~crosses & ~goes_back
    return F.coalesce(may if doubtful is None else may & (is_generic | doubtful), F.lit(False))


def ensemble(rows: DataFrame, generic: list[str], labels: list[str] | None = None) -> DataFrame:
    """``rows`` with the surer of the guesses of text and image as category where it may replace it.

    ``rows`` has category, text_guess, text_confidence, image_guess and image_confidence (null or
    blank guess: none). An image counts only if surer than the text, if ``labels`` (where given) hold its guess,
    and if the text was unsure or the category generic. Adds category_before and
    category_confidence, null where the category stays.
    """
    sure = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    text, image = F.nullif(F.trim("text_guess"), F.lit("")), F.nullif(F.trim("image_guess"), F.lit(""))
    if labels is not None:
        image = F.when(image.isin(labels), image)
    by_image = image.isNotNull() & (sure("image_confidence") > sure("text_confidence"))
    guess = F.when(by_image, image).otherwise(text)
    confidence = F.when(by_image, sure("image_confidence")).otherwise(sure("text_confidence"))
    may = overrides(F.col("category"), guess, confidence, generic, ~by_image | (sure("text_confidence") < TEXT_CONFIDENCE))
    out = {"category": F.when(may, guess).otherwise(F.col("category")), "category_before": F.when(may, F.trim(F.coalesce("category", F.lit("")))), "category_confidence": F.when(may, F.round(confidence, 3))}
    return rows.withColumns(out)
