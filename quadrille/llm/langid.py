"""Language ID by Bayesian evidence fusion (operator 2).

Four kinds of evidence are added up as logarithms:

- text: a naive Bayes model of byte trigrams, trained here on a bounded sample of rows with a declared
  language (``per_language`` different texts each). Trigrams of a text are not independent, so their mean is weighted by
  the root of their number. The sample is in two folds by a hash of the text, and a document is scored by the model of
  the other fold: its own declaration, or that of a copy, is never behind the text evidence it meets;
- declared: P(declared markup language | language);
- suffix: the address's suffix, as the middle level of the prior;
- host: the prior itself, smoothed hierarchically: a host's counts lean on its suffix's and those on the
  corpus's, with ``lean`` pseudo-documents each.

Counts are expected counts under the text evidence alone, summed over all rows by grouped aggregation (combined
before the shuffle, so a host with a third of all rows is one row per task). Texts are never shuffled: the text
pass gives a few numbers per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.npx import U, column_bytes, mix, pieces
from quadrille.llm.remote import remote
from quadrille.session import ensure_checkpoint_dir

CELLS = 1 << 15


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of letters and single blanks, and how many each text has.

    ASCII letters are lower-cased; all other ASCII characters count as blanks, so digits, markup and
    punctuation say nothing; runs of blanks are one.
    """
    data, offsets = column_bytes(column)
    lower = data | 0x20
    letter = (lower >= 97) & (lower <= 122)
    x = np.where(letter, lower, np.where(data < 128, 32, data)).astype(np.uint8)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    first = offsets[:-1][offsets[:-1] < len(x)]
    keep[first] = True
    at = np.append(0, np.cumsum(keep))[offsets]
    x = x[keep].astype(U)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(len(column), np.int64)
    cells = (mix(x[:-2] | x[1:-1] << U(8) | x[2:] << U(16)) % U(CELLS)).astype(np.int64)
    row = np.repeat(np.arange(len(column)), np.diff(at))
    inside = (row[:-2] == row[2:]) & ~((x[:-2] == 32) & (x[2:] == 32))
    return cells[inside], np.bincount(row[:-2][inside], minlength=len(column)).astype(np.int64)


SLACK = 2.5  # nats per trigram
NEVER = -50.0  # log-likelihood per trigram in a language that a fold has no text of


class Model:
    """log P(trigram | language) by fold; ``floor`` is ``SLACK`` below the mean per trigram of training texts.

    Text in the language with foreign passages stays above the floor; random letters lie below it. Fold f of the
    tables is made of all texts but those of fold f, and scores the documents of fold f; a single fold scores all.
    """

    def __init__(self, languages: list[str], folds: int = 1) -> None:
        self.languages, self.folds = languages, folds
        self.table = np.full((len(languages), folds, CELLS), NEVER, np.float32)
        self.floor = np.full((len(languages), folds), np.inf)

    def lacks(self, fold: int) -> list[str]:
        """The languages that a fold's table knows nothing of."""
        return [name for name, floor in zip(self.languages, self.floor[:, fold]) if np.isposinf(floor)]

    def fit(self, language: int, fold: int, counts: np.ndarray, shares: np.ndarray, long: int) -> None:
        """From the trigram counts of some texts, and the sum of the long ones' shares."""
        seen = counts + 0.05
        logs = np.log(seen / seen.sum())
        self.table[language, fold] = logs
        self.floor[language, fold] = (shares / long * logs).sum() - SLACK if long else -np.inf

    @classmethod
    def of(cls, rows: list[tuple[str, str]]) -> Model:
        """A model of one fold of (language, text)."""
        model = cls(sorted({lang for lang, _ in rows}))
        for k, lang in enumerate(model.languages):
            model.fit(k, 0, *_counted(pa.array([text for name, text in rows if name == lang], pa.string())))
        return model


def _counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Trigram counts of texts, the sum of the shares of those of 100 trigrams or more, and how many those are."""
    cells, counts = trigrams(texts)
    long = counts >= 100
    weight = np.repeat(np.where(long, 1.0 / np.maximum(counts, 1), 0.0), counts)
    return np.bincount(cells, minlength=CELLS).astype(np.float64), np.bincount(cells, weight, CELLS), int(long.sum())


def _text_evidence(batches, model: Model):
    k = len(model.languages)
    flat_tables = model.table.reshape(k, model.folds * CELLS)
    for batch in pieces(batches, "_text"):
        cells, counts = trigrams(batch.column("_text"))
        fold = batch.column("_fold").to_numpy()
        where = cells + np.repeat(fold.astype(np.int64) * CELLS, counts)
        at = np.append(0, np.cumsum(counts))
        means = np.empty((batch.num_rows, k))
        for j in range(k):
            total = np.append(0, np.cumsum(flat_tables[j][where], dtype=np.float64))
            means[:, j] = (total[at[1:]] - total[at[:-1]]) / np.maximum(counts, 1)
        best = means.argmax(axis=1) if k else np.zeros(batch.num_rows, np.int64)
        fits = means[np.arange(batch.num_rows), best] >= model.floor[best, fold] if k else np.ones(batch.num_rows, bool)
        arrays = dict(zip(batch.schema.names, batch.columns))
        arrays.pop("_text")
        logs = means * np.sqrt(counts)[:, None]
        shares = np.exp(logs - logs.max(axis=1, keepdims=True)) if k else logs
        shares /= np.maximum(shares.sum(axis=1, keepdims=True), 1e-300)
        at = pa.array(np.arange(batch.num_rows + 1) * k, pa.int32())
        arrays["_grams"] = pa.array(counts)
        arrays["_fits"] = pa.array((fits | (counts < 100)) & (counts > 0))
        arrays["_text_log"] = pa.ListArray.from_arrays(at, pa.array(logs.ravel()))
        arrays["_share"] = pa.ListArray.from_arrays(at, pa.array(shares.ravel()))
        yield pa.RecordBatch.from_pydict(arrays)


def _new_texts(batches):
    """The rows (lang, _h, text) whose lang and _h have not come before in the partition."""
    seen: set[tuple] = set()
    for batch in batches:
        new = []
        for k, key in enumerate(zip(batch.column("lang").to_pylist(), batch.column("_h").to_pylist())):
            if key not in seen:
                seen.add(key)
                new.append(k)
        yield batch.take(pa.array(new, pa.int64()))


def _fitted(batches):
    """Counts by language and fold of the sample; all rows of both are in one partition."""
    found: dict[tuple[str, int], list] = {}
    for batch in pieces(batches, "text"):
        keys = list(zip(batch.column("lang").to_pylist(), batch.column("_fold").to_pylist()))
        for key in set(keys):
            part = batch.column("text").filter(pa.array([k == key for k in keys]))
            sums = found.setdefault(key, [np.zeros(CELLS), np.zeros(CELLS), 0])
            for n, x in enumerate(_counted(part)):
                sums[n] += x
    for (lang, fold), (counts, shares, long) in found.items():
        yield pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([lang]),
                "fold": pa.array([fold], pa.int32()),
                "counts": pa.array([counts.astype(np.float32).tobytes()]),
                "shares": pa.array([shares.astype(np.float32).tobytes()]),
                "long": pa.array([long], pa.int64()),
            }
        )


def fold_of(text: Column, folds: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), text), F.lit(folds)).cast("int")


def sample(rows: DataFrame, per_language: int, most_languages: int) -> DataFrame | None:
    """(lang, _h, text): ``per_language`` different texts at most of each of the most frequent languages, those of least hash.

    A hash below the share of different texts that is wanted picks them where they are read, with some to spare, so only
    a bounded number of rows moves. None if no row has a language and a text.
    """
    labelled = rows.filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("_h", F.xxhash64("lang", "text"))
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("_h").alias("texts"))
    common = sizes.orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not common:
        return None
    bounds = F.create_map(
        *[F.lit(x) for lang, _, n in common for x in (lang, int(-(1 << 63) + ((1 << 64) - 1) * min(1.0, 2 * per_language / n)) if n > 2 * per_language else (1 << 63) - 1)]
    )
    low = labelled.filter(F.col("_h") <= F.try_element_at(bounds, F.col("lang"))).select("lang", "_h", "text")
    new = low.mapInArrow(remote(__name__, "_new_texts"), "lang string, _h long, text string").dropDuplicates(["lang", "_h"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))
    return new.withColumn("_rank", rank).filter(F.col("_rank") <= per_language).select("lang", "_h", "text")


def train(rows: DataFrame, per_language: int = 400, most_languages: int = 64, folds: int = 2) -> Model:
    """A model of (lang, text) from ``per_language`` different texts at most in each of ``most_languages`` languages.

    Fitting takes a bounded sample by intent. Texts are counted where they are; the driver gets one vector per language
    and fold.
    """
    picked = sample(rows, per_language, most_languages)
    if picked is None:
        return Model([], folds)
    by_fold = picked.withColumn("_fold", fold_of(F.col("text"), folds)).repartition("lang", "_fold")
    shape = "lang string, fold int, counts binary, shares binary, long long"
    found = by_fold.mapInArrow(remote(__name__, "_fitted"), shape).collect()
    model = Model(sorted({r.lang for r in found}), folds)
    for k, lang in enumerate(model.languages):
        for fold in range(folds):
            parts = [r for r in found if r.lang == lang and (folds == 1 or r.fold != fold)]
            if parts:
                vectors = [sum(np.frombuffer(r[c], np.float32).astype(np.float64) for r in parts) for c in ("counts", "shares")]
                model.fit(k, fold, *vectors, sum(r.long for r in parts))
    return model


def declared_language(markup: Column) -> Column:
    """The primary subtag of a declared language, or null."""
    tag = F.lower(F.regexp_extract(F.coalesce(markup, F.lit("")), "^\\s*([A-Za-z]{2,3})(?:[-_].*|\\s*)$", 1))
    return F.when(tag != "", tag)


def markup_language(html: Column) -> Column:
    """The lang attribute of a page's html element."""
    return F.regexp_extract(F.coalesce(html, F.lit("")), "(?is)<html\\b[^>]*?\\blang\\s*=\\s*[\"']?([A-Za-z_-]+)", 1)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def identify(
    docs: DataFrame,
    model: Model,
    text_col: str = "text",
    declared: Column | None = None,
    host: Column | None = None,
    least: float = 0.6,
    lean: float = 20.0,
) -> DataFrame:
    """``docs`` without its text, with language, probability and kept.

    A text without letters has no language and is rejected, as is one that no language's model fits (if
    it has 100 trigrams or more) and one whose best language has a posterior below ``least``. A model without languages
    says nothing: language and probability are null, and texts with letters are kept. Null texts are empty; null hosts
    and declarations are values of their own. Rows are independent but for the counts, in which repeated rows count
    each time. Columns named language, probability or kept are replaced. An empty table gives an empty result.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    languages = model.languages
    others = [c for c in docs.columns if c not in {text_col, "language", "probability", "kept"}]
    host = F.coalesce(host, F.lit("")) if host is not None else F.lit("")
    rows = docs.select(
        *others,
        host.alias("_host"),
        F.regexp_extract(host, "\\.([A-Za-z]{2,24})$", 1).alias("_suffix"),
        F.coalesce(declared_language(declared) if declared is not None else F.lit(None), F.lit("")).alias("_declared"),
        fold_of(F.col(text_col), model.folds).alias("_fold"),
        F.col(text_col).alias("_text"),
    )
    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text"]
    shape += ["_grams long", "_fits boolean", "_text_log array<double>", "_share array<double>"]
    rows = rows.mapInArrow(remote(__name__, "_text_evidence", model=model), ", ".join(shape)).checkpoint()
    if not languages:
        nothing = F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability")
        return rows.select(*others, *nothing, (F.col("_grams") > 0).alias("kept"))

    # expected counts by host, suffix and declaration: one aggregate per language, combined before the shuffle
    k_range = range(len(languages))
    expected = rows.filter("_grams > 0").select("_host", "_suffix", "_declared", *[F.col("_share")[k].alias(f"c{k}") for k in k_range])
    sums = [F.sum(f"c{k}").alias(f"c{k}") for k in k_range]
    hosts = expected.groupBy("_host", "_suffix").agg(*sums)
    suffixes = hosts.groupBy("_suffix").agg(*sums)
    corpus = [float(x) for x in suffixes.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0.0)) + 1 for k in k_range]).first()]
    base = F.array(*[F.lit(x / sum(corpus)) for x in corpus])
    counts = F.array(*[F.col(f"c{k}") for k in k_range])

    def leaning(own: Column, prior: Column) -> Column:
        n = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(own, prior, lambda c, p: (c + lean * p) / (n + lean))

    priors = hosts.select("_host", "_suffix", counts.alias("own")).join(suffixes.select("_suffix", counts.alias("all")), "_suffix")
    priors = priors.withColumn("of_suffix", leaning(F.col("all"), base))
    priors = priors.select("_host", F.transform(leaning(F.col("own"), F.col("of_suffix")), lambda x: F.ln(x)).alias("_prior"))
    said = expected.groupBy("_declared").agg(*sums)
    said = said.select("_declared", F.array(*[F.log((F.col(f"c{k}") + 0.5) / (corpus[k] + 0.5)) for k in k_range]).alias("_said"))

    joined = rows.drop("_share").join(priors, "_host", "left").join(said, "_declared", "left")
    logs = F.zip_with("_text_log", F.coalesce("_prior", F.transform(base, lambda x: F.ln(x))), lambda a, b: a + b)
    logs = F.when((F.col("_declared") == "") | F.col("_said").isNull(), logs).otherwise(F.zip_with(logs, "_said", lambda a, b: a + b))
    found = joined.select(*others, "_grams", "_fits", logs.alias("_logs")).withColumn("_top", F.array_max("_logs"))
    # the best one's posterior: its own weight is exp(0)
    weight = F.aggregate("_logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    found = found.withColumn("_p", 1 / weight)
    known = F.col("_grams") > 0
    names = F.array(*[F.lit(name) for name in languages])
    return found.select(
        *others,
        F.when(known, F.element_at(names, F.array_position("_logs", F.col("_top")).cast("int"))).alias("language"),
        F.when(known, F.col("_p")).otherwise(F.lit(0.0)).alias("probability"),
        (known & F.col("_fits") & (F.col("_p") >= least)).alias("kept"),
    )


def identify_documents(docs: DataFrame, carry: tuple[str, ...] = (), **options) -> DataFrame:
    """doc_id, declared, language, probability, kept of documents (doc_id, text, lang, source), and the columns ``carry``.

    A document with letters whose declared language the model that scores it lacks (a rare one, or one all whose texts
    are copies) is kept as declared, with a null probability. A source stands for the host; it has a suffix only
    where it looks like an address.
    """
    model = train(docs.select("lang", "text"))
    rows = docs.select(*carry, "doc_id", "text", "lang", "source", fold_of(F.col("text"), model.folds).alias("_own_fold"))
    found = identify(rows, model, declared=F.col("lang"), host=F.col("source"), **options)
    lacking = ~F.col("lang").isin(model.languages) if model.languages else F.lit(True)
    for fold in range(model.folds):
        if names := model.lacks(fold):
            lacking = lacking | (F.col("_own_fold") == fold) & F.col("lang").isin(names)
    unknown = F.coalesce(F.col("language").isNotNull() & F.col("lang").isNotNull() & lacking, F.lit(False))
    return found.select(
        *carry,
        "doc_id",
        F.col("lang").alias("declared"),
        F.when(unknown, F.col("lang")).otherwise(F.col("language")).alias("language"),
        F.when(~unknown, F.col("probability")).alias("probability"),
        (F.col("kept") | unknown).alias("kept"),
    )


def identify_pages(pages: DataFrame, docs: DataFrame, **options) -> DataFrame:
    """page_id, declared, language, probability, kept of pages, by a model of ``docs``.

    The text is what follows when tags are dropped; language declaration and address are the page's.
    """
    text = F.regexp_replace(F.coalesce("html", F.lit("")), "(?is)<(script|style)\\b.*?</\\1\\s*>|<[^>]*>", " ")
    rows = pages.select("page_id", "url", markup_language(F.col("html")).alias("declared"), text.alias("text"))
    found = identify(rows, train(docs.select("lang", "text"), folds=1), declared=F.col("declared"), host=host_of(F.col("url")), **options)
    return found.select("page_id", "declared", "language", "probability", "kept")
