"""Corpus preparation queries: filters, remaps, text cleaning, ranking, splits, sampling, batches."""
from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import prep
from tessera.plans import sqlparts as S
from tessera.plans.registry import query
from tessera.sources import tables

DOCS = ("docs AS (SELECT d.doc_id, r.class_index, d.source AS title, d.text AS description, d.lang "
        "FROM documents d LEFT JOIN (SELECT lang, CAST(dense_rank() OVER (ORDER BY lang) AS INTEGER) AS class_index "
        "FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)) r ON r.lang = d.lang)")
HASH = "md5(concat('42:', CAST({id} AS VARCHAR)))"
HEAD = (f"{S.VECS}, vr AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) AS rn FROM vecs), "
        "head AS (SELECT id, label, rn FROM vr WHERE rn <= (SELECT min(c) FROM "
        "(SELECT count(*) AS c FROM vecs GROUP BY label)))")

# fixed values: dictionary remap of languages (unknown keys are an error)
LANG_CODES = {"en": 1, "fr": 2, "de": 3, "es": 4}
# fixed values: token window length and batch size of the balanced reader
TOKEN_WINDOW = 256
BATCH_SIZE = 4


def corpus(spark, sf_dir):
    return tables.text_corpus(spark, sf_dir)


@query("class_sizes", f"WITH {DOCS}, s AS (SELECT class_index, count(*) AS n FROM docs "
       "WHERE class_index IS NOT NULL GROUP BY class_index) "
       "SELECT class_index, n, (SELECT min(n) FROM s) AS min_n FROM s")
def class_sizes(spark, sf_dir):
    """A1/A2: rows per class and the smallest class size."""
    return prep.class_sizes(corpus(spark, sf_dir), "class_index")


@query("class_row_number", f"WITH {DOCS} SELECT doc_id, class_index, "
       "row_number() OVER (PARTITION BY class_index ORDER BY doc_id) AS rn FROM docs")
def class_row_number(spark, sf_dir):
    """Row number within class in id order (bucketed, skew-safe)."""
    return prep.rank_by_id(corpus(spark, sf_dir).select("doc_id", "class_index"), ["class_index"], "doc_id")


@query("class_head", f"WITH {HEAD} SELECT id, label, rn FROM head")
def class_head(spark, sf_dir):
    """First m rows of each class, m = smallest class."""
    v = tables.vectors(spark, sf_dir).select("id", "label")
    return prep.class_head(v, "label", "id")


@query("stratified_zip", f"WITH {HEAD} SELECT rn AS sample, count(*) AS n_items, "
       "string_agg(CAST(id AS VARCHAR), ',' ORDER BY label) AS ids FROM head GROUP BY rn")
def stratified_zip(spark, sf_dir):
    """Sample i = row i of every class; ids listed in class order."""
    v = tables.vectors(spark, sf_dir).select("id", "label")
    z = prep.stratified_zip(v, "label", "id", [])
    return z.select("sample", F.size("items").cast("long").alias("n_items"),
                    F.array_join(F.transform("items", lambda t: t["id"].cast("string")), ",").alias("ids"))


@query("batch_rows", f"WITH {HEAD} SELECT id, label, rn AS sample, "
       f"CAST(floor((rn - 1) / {BATCH_SIZE}) AS BIGINT) AS batch_id FROM head")
def batch_rows(spark, sf_dir):
    """Balanced rows with sample number and batch id (remainder batch kept)."""
    v = tables.vectors(spark, sf_dir).select("id", "label")
    return prep.batch_rows(v, "label", "id", BATCH_SIZE).select("id", "label", "sample", "batch_id")


@query("filter_class_ne", f"WITH {DOCS} SELECT doc_id, class_index FROM docs WHERE class_index <> 2")
def filter_class_ne(spark, sf_dir):
    """Class != 2."""
    return corpus(spark, sf_dir).where(F.col("class_index") != 2).select("doc_id", "class_index")


@query("filter_class_eq", f"WITH {DOCS} SELECT class_index, count(*) AS n, min(doc_id) AS first_doc "
       "FROM docs WHERE class_index IS NOT NULL GROUP BY class_index")
def filter_class_eq(spark, sf_dir):
    """The equality filters of all classes as one grouped pass."""
    return corpus(spark, sf_dir).where(F.col("class_index").isNotNull()).groupBy("class_index").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query("drop_any_null", f"WITH {DOCS} SELECT d.doc_id, d.class_index, d.title, l.quality, l.toxic "
       "FROM docs d LEFT JOIN labels l ON l.doc_id = d.doc_id "
       "WHERE d.class_index IS NOT NULL AND d.title IS NOT NULL AND l.quality IS NOT NULL AND l.toxic IS NOT NULL")
def drop_any_null(spark, sf_dir):
    """Drop rows with any null (documents left-joined with labels)."""
    d = corpus(spark, sf_dir).select("doc_id", "class_index", "title")
    lab = tables.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return d.join(lab, "doc_id", "left").na.drop("any")


@query("remap_when", f"WITH {DOCS} SELECT doc_id, CASE WHEN class_index < 2 THEN 1 WHEN class_index > 2 THEN 2 "
       "ELSE class_index END AS class_index FROM docs WHERE class_index <> 2")
def remap_when(spark, sf_dir):
    """P5: filter class 2 out, then <2 -> 1 and >2 -> 2."""
    d = corpus(spark, sf_dir).where(F.col("class_index") != 2)
    return d.select("doc_id", prep.remap_two_way("class_index").alias("class_index"))


@query("prep_reviews", f"WITH {DOCS} SELECT doc_id, CASE WHEN class_index < 2 THEN 1 WHEN class_index > 2 "
       "THEN 2 ELSE class_index END AS class_index, replace(description, '\\n', '') AS title FROM docs "
       "WHERE class_index <> 2 AND class_index IS NOT NULL AND description IS NOT NULL")
def prep_reviews(spark, sf_dir):
    """Review-corpus preparation (rename, filter, remap, drop nulls, clean)."""
    d = corpus(spark, sf_dir).select("doc_id", "class_index", "description").toDF("doc_id", "class_index", "title")
    d = d.where(F.col("class_index") != 2).withColumn("class_index", prep.remap_two_way("class_index"))
    d = d.na.drop("any")
    return d.withColumn("title", T.remove_literal("title", T.LITERAL_BACKSLASH_N))


@query("rename_positional", f"WITH {DOCS} SELECT class_index AS \"Class Index\", title AS \"Title\", "
       "lang AS temp, description AS \"Description\" FROM docs")
def rename_positional(spark, sf_dir):
    """Columns renamed by position."""
    d = corpus(spark, sf_dir).select("class_index", "title", "lang", "description")
    return d.toDF("Class Index", "Title", "temp", "Description")


_lang_case = " ".join(f"WHEN '{k}' THEN {v}" for k, v in LANG_CODES.items())


@query("remap_dict", f"SELECT doc_id, CAST(CASE lang {_lang_case} END AS INTEGER) AS lang_code FROM documents")
def remap_dict(spark, sf_dir):
    """Dictionary remap of a string key (unknown key raises)."""
    d = tables.table(spark, sf_dir, "documents")
    return d.select("doc_id", prep.remap_dict("lang", LANG_CODES).alias("lang_code"))


@query("cast_label", "SELECT doc_id, TRY_CAST(substr(source, 4) AS INTEGER) AS source_no FROM documents")
def cast_label(spark, sf_dir):
    """Cast a text label to int (bad values become null)."""
    d = tables.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.expr("try_cast(substring(source, 4) AS INT)").alias("source_no"))


@query("label_rebase", f"WITH {DOCS} SELECT doc_id, class_index - 1 AS class0 FROM docs")
def label_rebase(spark, sf_dir):
    """1-based class -> 0-based."""
    return corpus(spark, sf_dir).select("doc_id", (F.col("class_index") - 1).alias("class0"))


@query("label_pm1", "SELECT doc_id, CASE WHEN quality = 0 THEN -1 ELSE quality END AS y_quality, "
       "CASE WHEN toxic = 0 THEN -1 ELSE toxic END AS y_toxic FROM labels")
def label_pm1(spark, sf_dir):
    """Label 0 -> -1."""
    lab = tables.table(spark, sf_dir, "labels")
    return lab.select("doc_id", prep.label_pm1("quality").alias("y_quality"), prep.label_pm1("toxic").alias("y_toxic"))


@query("one_hot", f"WITH {DOCS} SELECT doc_id, array_to_string(list_transform(range((SELECT max(class_index) FROM docs)), "
       "lambda i: CASE WHEN i = class_index - 1 THEN 1 ELSE 0 END), ',') AS one_hot FROM docs")
def one_hot(spark, sf_dir):
    """One-hot vector of the 1-based class over all classes."""
    d = corpus(spark, sf_dir)
    oh = prep.one_hot("class_index", len(tables.class_names(tables.table(spark, sf_dir, "documents"), "lang")), base=1)
    return d.select("doc_id", F.array_join(F.transform(oh, lambda x: x.cast("string")), ",").alias("one_hot"))


@query("seeded_shuffle", f"SELECT doc_id, row_number() OVER (ORDER BY {HASH.format(id='doc_id')}, doc_id) AS pos "
       "FROM documents")
def seeded_shuffle(spark, sf_dir):
    """Deterministic shuffle order md5('42:' || id)."""
    d = tables.table(spark, sf_dir, "documents").select("doc_id")
    return prep.shuffle_order(d, "doc_id")


@query("split_70_30", f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {HASH.format(id='doc_id')}, doc_id) "
       "<= floor(0.7 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM documents")
def split_70_30(spark, sf_dir):
    """First int(0.7 n) shuffled rows are train."""
    d = tables.table(spark, sf_dir, "documents").select("doc_id")
    return prep.split_positional(d, "doc_id").select("doc_id", "split")


@query("stratified_split", f"WITH {DOCS} SELECT doc_id, class_index, CASE WHEN row_number() OVER "
       f"(PARTITION BY class_index ORDER BY {HASH.format(id='doc_id')}, doc_id) <= count(*) OVER "
       "(PARTITION BY class_index) - ceil(0.3 * count(*) OVER (PARTITION BY class_index)) "
       "THEN 'train' ELSE 'test' END AS split FROM docs")
def stratified_split(spark, sf_dir):
    """Per class, test = ceil(0.3 n_c) rows of the shuffled class."""
    d = corpus(spark, sf_dir).select("doc_id", "class_index")
    return prep.split_stratified(d, "class_index", "doc_id").select("doc_id", "class_index", "split")


@query("balanced_downsample", "WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality "
       f"ORDER BY {HASH.format(id='doc_id')}, doc_id) AS pos FROM labels WHERE quality IN (0, 1)) "
       "SELECT doc_id, quality FROM r WHERE pos <= (SELECT min(c) FROM (SELECT count(*) AS c FROM labels "
       "WHERE quality IN (0, 1) GROUP BY quality))")
def balanced_downsample(spark, sf_dir):
    """min(n_1, n_0) hash-ordered rows of each binary label (train side)."""
    lab = tables.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return prep.balanced_downsample(lab, "quality", "doc_id").select("doc_id", "quality")


@query("union_classes", f"WITH {DOCS} SELECT doc_id, class_index FROM docs WHERE class_index IS NOT NULL")
def union_classes(spark, sf_dir):
    """The rows of all classes with their class index, in one scan."""
    return corpus(spark, sf_dir).where(F.col("class_index").isNotNull()).select("doc_id", "class_index")


@query("multiset_intersection", "SELECT lang, count(*) AS n FROM ("
       "SELECT d.lang FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1 "
       "INTERSECT ALL SELECT d.lang FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 0) "
       "GROUP BY lang")
def multiset_intersection(spark, sf_dir):
    """Multiset intersection (INTERSECT ALL) of two label-derived multisets of languages."""
    d = tables.table(spark, sf_dir, "documents").select("doc_id", "lang")
    lab = tables.table(spark, sf_dir, "labels")
    a = d.join(lab.where(F.col("quality") == 1), "doc_id").select("lang")
    b = d.join(lab.where(F.col("toxic") == 0), "doc_id").select("lang")
    return a.intersectAll(b).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


# ---- text functions ----------------------------------------------------------------------

_RAW = ("replace(replace(text, chr(10) || chr(10), '<br /><br />'), chr(10), '<br />\\n')")


@query("clean_text", f"SELECT doc_id, replace(replace(replace({_RAW}, '<br /><br />', ''), '<br />\\n', ''), "
       "'\\n', '') AS text_clean FROM documents")
def clean_text(spark, sf_dir):
    """remove HTML breaks and literal backslash-n (raw form escapes the real newlines)."""
    d = tables.table(spark, sf_dir, "documents")
    raw = F.replace(F.replace("text", F.lit("\n\n"), F.lit(T.BR_DOUBLE)), F.lit("\n"), F.lit(T.BR_BACKSLASH_N))
    return d.select("doc_id", T.clean_text(raw).alias("text_clean"))


@query("newline_to_space", "SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents")
def newline_to_space(spark, sf_dir):
    """real newline -> space."""
    d = tables.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.newline_to_space("text").alias("text"))


_NULLS = ("SELECT d.doc_id, CASE WHEN l.quality = 1 THEN d.source END AS title, "
          "CASE WHEN l.toxic = 0 OR l.toxic IS NULL THEN d.text END AS description "
          "FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")


def _with_nulls(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents")
    lab = tables.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id", "left")
    return j.select("doc_id", F.when(F.col("quality") == 1, F.col("source")).alias("title"),
                    F.when((F.col("toxic") == 0) | F.col("toxic").isNull(), F.col("text")).alias("description"))


@query("compose_text", f"SELECT doc_id, coalesce(title || ' ' || description, description, title) AS text "
       f"FROM ({_NULLS})")
def compose_text(spark, sf_dir):
    """title + ' ' + description, else description, else title (nulls from the labels join)."""
    return _with_nulls(spark, sf_dir).select("doc_id", T.compose_text("title", "description").alias("text"))


@query("compose_text_strict", "SELECT doc_id, source || ' ' || text AS text FROM documents")
def compose_text_strict(spark, sf_dir):
    """title + ' ' + description; a null part fails the query."""
    d = tables.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.compose_text_strict("source", "text").alias("text"))


@query("compose_text_nan", f"SELECT doc_id, coalesce(title, 'nan') || ' ' || coalesce(description, 'nan') AS text "
       f"FROM ({_NULLS})")
def compose_text_nan(spark, sf_dir):
    """stringify-then-concat; a null part becomes 'nan'."""
    return _with_nulls(spark, sf_dir).select("doc_id", T.compose_text_nan("title", "description").alias("text"))


@query("token_window", "WITH t AS (SELECT doc_id, CASE WHEN length(trim(text)) = 0 THEN []::VARCHAR[] "
       "ELSE string_split_regex(trim(text), '\\s+') END AS toks FROM documents) "
       f"SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, CAST(least(len(toks), {TOKEN_WINDOW}) AS INTEGER) AS n_real, "
       f"array_to_string(list_resize(toks[1:{TOKEN_WINDOW}], {TOKEN_WINDOW}, '{T.PAD_TOKEN}'), ' ') AS window, "
       f"CAST(least(len(toks), {TOKEN_WINDOW}) AS BIGINT) AS mask_sum FROM t")
def token_window(spark, sf_dir):
    """whole-text tokens, truncated and padded to 256, with the 0/1 mask."""
    d = tables.table(spark, sf_dir, "documents")
    window, mask, n_real = T.token_window("text", TOKEN_WINDOW)
    return d.select("doc_id", F.size(T.tokens("text")).alias("n_tokens"), n_real.alias("n_real"),
                    F.array_join(window, " ").alias("window"),
                    F.size(F.array_remove(mask, 0)).cast("long").alias("mask_sum"))
