"""Sources and sinks, the metric-gated save, the fit loop, and the text encoder."""
from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import layout as L
from tessera.functions.encoders import DIM, SLOTS, embed, encode
from tessera.operators import assign, metrics, prep
from tessera.operators.objectives import cross_entropy_double_softmax
from tessera.plans import q_prep
from tessera.plans import sqlparts as S
from tessera.plans.q_core import REPORT_SQL, scored_vectors
from tessera.plans.q_match import _BATCH
from tessera.plans.q_prep import DOCS, HASH
from tessera.plans.q_vectors import _CE
from tessera.plans.registry import ORACLE, query
from tessera.session import materialize, stage_path
from tessera.sources import files, tables

# fixed values: gate of the metric-gated save (strictly above), plateau rule of the fit loop
STORE_THRESHOLD = 0.75
PLATEAU_FACTOR = 0.5
PLATEAU_PATIENCE = 2
LEAST_SCALE = 0.3
# fixed values: per-language path prefix of the file manifest
MANIFEST_PREFIX = {"en": "EN_set/", "fr": "FR_set/", "de": "DE_set/", "es": "ES_set/"}
MANIFEST_ITEMS = 100

CORPUS_SCHEMA = "doc_id BIGINT, class_index INT, title STRING, description STRING"


@query("scan_text_csv", f"WITH {DOCS} SELECT doc_id, class_index, title, description FROM docs")
def scan_text_csv(spark, sf_dir):
    """CSV scan with a header and a fixed schema (multi-line quoted texts)."""
    corpus = tables.text_corpus(spark, sf_dir).select("doc_id", "class_index", "title", "description")
    path = stage_path(spark, "corpus-csv")
    files.write_csv(corpus, path)
    return files.read_csv(spark, path, CORPUS_SCHEMA)


@query("sink_roundtrip", ORACLE["prep_reviews"])
def sink_roundtrip(spark, sf_dir):
    """The prepared review table written (parquet, no index column) and read back."""
    path = stage_path(spark, "reviews")
    q_prep.prep_reviews(spark, sf_dir).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query("sink_csv", ORACLE["prep_reviews"])
def sink_csv(spark, sf_dir):
    """The prepared review table through the CSV sink (header, quoted multi-line texts) and back."""
    prepared = q_prep.prep_reviews(spark, sf_dir)
    path = stage_path(spark, "reviews-csv")
    files.write_csv(prepared, path)
    return files.read_csv(spark, path, prepared.schema)


@query("shuffled_shards", f"SELECT doc_id, pos, CASE WHEN pos <= floor(0.7 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS goal FROM "
       f"(SELECT doc_id, row_number() OVER (ORDER BY {HASH.format(id='doc_id')}, doc_id) AS pos FROM documents)")
def shuffled_shards(spark, sf_dir):
    """The seeded shuffle written as shards whose order is the shuffled order; the 70/30 split is a folder boundary."""
    path = stage_path(spark, "shuffled")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files.write_shuffled(tables.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", path, shards)
    return files.read_shuffled(spark, path).select("doc_id", "pos", "goal")


_SPLIT = (f"sp AS (SELECT doc_id, lang, CASE WHEN row_number() OVER (ORDER BY {HASH.format(id='doc_id')}, doc_id) "
          "<= floor(0.7 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS goal FROM documents)")


def _split_docs(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    s = prep.split_positional(d.select("doc_id"), "doc_id").select("doc_id", F.col("split").alias("goal"))
    return d.join(s, "doc_id")


@query("scan_partitioned", f"WITH {_SPLIT} SELECT doc_id, lang, goal FROM sp WHERE goal = 'train' AND lang = 'en'")
def scan_partitioned(spark, sf_dir):
    """goal/type/lang folder layout; the filter prunes folders instead of reading them."""
    path = stage_path(spark, "by-goal-lang")
    files.write_partitioned(_split_docs(spark, sf_dir).withColumn("data_type", F.lit("random")), path,
                            ["goal", "data_type", "lang"])
    back = spark.read.parquet(path)
    return back.where((F.col("goal") == "train") & (F.col("data_type") == "random") & (F.col("lang") == "en")) \
        .select("doc_id", "lang", "goal")


@query("catalog_load", f"WITH {DOCS}, {_SPLIT} SELECT d.doc_id, d.class_index, d.title, d.description FROM docs d JOIN sp USING (doc_id) "
       "WHERE sp.goal = 'test'")
def catalog_load(spark, sf_dir):
    """S3/U4: (dataset, goal) -> path catalog; loads the test split of the corpus."""
    corpus = tables.text_corpus(spark, sf_dir).select("doc_id", "class_index", "title", "description")
    split = prep.split_positional(corpus.select("doc_id"), "doc_id").select("doc_id", "split")
    both = corpus.join(split, "doc_id")
    cat = files.Catalog(spark)
    for goal in ("train", "test"):
        path = stage_path(spark, f"corpus-{goal}")
        both.where(F.col("split") == goal).drop("split").write.mode("overwrite").parquet(path)
        cat.register("corpus", goal, path)
    return cat.load("corpus", "test")


@query("scan_text_dir", f"WITH {DOCS}, f AS (SELECT 'class_index=' || class_index AS folder, description FROM docs "
       "WHERE class_index IS NOT NULL) SELECT CAST(dense_rank() OVER (ORDER BY folder) AS INTEGER) AS class_rank, folder, "
       "count(*) AS n_texts, CAST(sum(length(description)) AS BIGINT) AS n_chars FROM f GROUP BY folder")
def scan_text_dir(spark, sf_dir):
    """A folder per class with one file per text; one row per file, line breaks kept, class = rank of its folder."""
    path = stage_path(spark, "text-files")
    corpus = tables.text_corpus(spark, sf_dir).where(F.col("class_index").isNotNull())
    files.write_text_files(corpus, path, "class_index", "description")
    # the files are opened once; a folder's rank is looked up for its one row
    folders = materialize(files.read_text_files(spark, path).groupBy("folder").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum(F.length("text")).cast("long").alias("n_chars")), "text-folders")
    return tables.with_class_rank(folders, "folder", "class_rank").select("class_rank", "folder", "n_texts", "n_chars")


_CORNERS = ("'[[' || x || ', ' || y || '], [' || (x + 40) || ', ' || y || '], [' || (x + 40) || ', ' || (y + 12) || '], [' || x || ', ' || (y + 12) || ']]'")


@query("scan_page_xml", f"SELECT conv_id AS page, turn AS item, role AS reading_order, {_CORNERS} AS corners FROM "
       "(SELECT *, conv_id * 7 % 3000 AS x, turn * 13 % 5000 AS y FROM conversations)")
def scan_page_xml(spark, sf_dir):
    """Page annotations (reading order and the corner list of the box) written as XML and read back with a row tag
    and a fixed schema."""
    path = stage_path(spark, "pages-xml")
    x, y = F.col("page") * 7 % 3000, F.col("item") * 13 % 5000
    corner = lambda a, b: F.concat(F.lit("["), a.cast("string"), F.lit(", "), b.cast("string"), F.lit("]"))
    corners = F.concat(F.lit("["), F.concat_ws(", ", corner(x, y), corner(x + 40, y), corner(x + 40, y + 12), corner(x, y + 12)), F.lit("]"))
    files.write_xml(tables.annotations(spark, sf_dir).withColumn("corners", corners), path, "region", "page")
    return files.read_xml(spark, path, "region", "page BIGINT, item BIGINT, reading_order STRING, corners STRING")


_RECT = ("r AS (SELECT conv_id AS page, turn AS item, role, conv_id * 7 % 3000 AS x, turn * 13 % 5000 AS y, "
         "row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations), "
         "g AS (SELECT page, role, dense_rank() OVER (PARTITION BY page ORDER BY min(pos)) - 1 AS group_id FROM r GROUP BY page, role)")


@query("page_xml_regions", f"WITH {_RECT} SELECT r.page, CAST(r.pos AS INTEGER) AS pos, CAST(x AS INTEGER) AS r1, CAST(y AS INTEGER) AS r2, "
       "CAST(x + 40 AS INTEGER) AS r3, CAST(y + 12 AS INTEGER) AS r4, g.group_id FROM r JOIN g ON g.page = r.page AND g.role IS NOT DISTINCT FROM r.role")
def page_xml_regions(spark, sf_dir):
    """S7 with F24 and W4: nested page annotations (a page, its regions, their corners) written as XML and read back;
    rectangle and reading-order group of each region."""
    path = stage_path(spark, "page-xml")
    x, y = (F.col("page") * 7 % 3000).cast("int"), (F.col("item") * 13 % 5000).cast("int")
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    corners = F.array(corner(x, y), corner(x + 40, y), corner(x + 40, y + 12), corner(x, y + 12))
    files.write_page_xml(tables.annotations(spark, sf_dir).withColumn("corner", corners), path)
    return files_regions(files.read_page_xml(spark, path))


def files_regions(pages_read):
    """(page, pos, r1..r4, group_id) of nested page annotations: corner 0 ++ corner 2, and ids by first appearance."""
    regions = files.page_regions(pages_read)
    groups = prep.first_appearance_order(regions, "reading_order", "pos", ["page"]).select(
        F.col("page").alias("_page"), F.col("reading_order").alias("_ro"), F.col("order").alias("group_id"))
    both = regions.join(groups, (F.col("page") == F.col("_page")) & F.col("reading_order").eqNullSafe(F.col("_ro")))
    rect = both.select("page", "pos", L.bbox_rect(F.col("bbox")).alias("r"), "group_id")
    return rect.select("page", "pos", *[F.col("r")[i].alias(f"r{i + 1}") for i in range(4)], "group_id")


_prefix_case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MANIFEST_PREFIX.items())


@query("manifest_paths", f"SELECT lang, (CASE lang {_prefix_case} END) || 'doc_' || CAST(doc_id AS VARCHAR) || '.xml' "
       "AS path FROM documents")
def manifest_paths(spark, sf_dir):
    """Manifest lines holding a list literal of file names -> paths with a per-language prefix."""
    d = tables.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    name = F.concat(F.lit("'doc_"), F.col("doc_id").cast("string"), F.lit(".xml'"))
    # one manifest line per (lang, source, block of 100 ids): every line stays small
    lines = d.groupBy("lang", "source", F.floor(F.col("doc_id") / MANIFEST_ITEMS).alias("blk")).agg(
        F.concat(F.lit("["), F.concat_ws(", ", F.collect_list(name)), F.lit("]")).alias("value"))
    path = stage_path(spark, "manifest")
    lines.select("lang", "value").write.mode("overwrite").partitionBy("lang").text(path)
    back = files.parse_manifest(spark.read.text(path))
    prefix = F.create_map(*[x for k, v in MANIFEST_PREFIX.items() for x in (F.lit(k), F.lit(v))])
    return back.select("lang", F.concat(F.element_at(prefix, F.col("lang")), F.col("path")).alias("path"))


def _batched(v):
    """Vectors with the batch they are in."""
    return v.join(prep.batches(v.select("id", "label"), "label", "id", 4).select("id", "batch_id"), "id")


def _batch_acc(batched, protos):
    sb = assign.assign_to_prototypes(batched, protos).select("id", "batch_id", "pred", "label", "qs", "cos")
    rep = metrics.batch_mean(metrics.clustering_report(sb.select("batch_id", "pred", "label"), ["batch_id"]), ["acc"])
    loss = cross_entropy_double_softmax(sb).agg(F.avg("loss").alias("loss"))
    return rep.crossJoin(loss)


@query("gated_save", f"SELECT acc_batch_mean, {STORE_THRESHOLD} AS threshold, acc_batch_mean > {STORE_THRESHOLD} AS saved "
       f"FROM ({_BATCH})")
def gated_save(spark, sf_dir, path: str | None = None, threshold: float = STORE_THRESHOLD):
    """Prototypes are written to ``path`` only when the batch-mean ACC is strictly above ``threshold``
    (``score_saved`` loads and scores them)."""
    v = tables.vectors(spark, sf_dir)
    protos = assign.class_mean_prototypes(v)
    acc = float(_batch_acc(_batched(v), protos).first()["acc_batch_mean"])
    if acc > threshold:
        protos.write.mode("overwrite").parquet(path or stage_path(spark, "prototypes"))
    return spark.createDataFrame([(acc, threshold, acc > threshold)], "acc_batch_mean double, threshold double, saved boolean")


def score_saved(spark, vectors, path: str):
    """Report of vectors (id, x, label) under saved prototypes."""
    scored = assign.assign_to_prototypes(vectors, spark.read.parquet(path), pred_only=True)
    return metrics.clustering_report(scored.select("pred", "label"))


_JOURNAL = "round int, loss double, acc double, saved boolean, scale double, best double, bad int, next_path string"


def journal_rounds(spark, journal: str) -> list:
    """The full rounds of a journal, in order: those before the first whose record was not committed."""
    rows = []
    while files.exists(spark, f"{journal}/round={len(rows)}/_SUCCESS"):
        rows.append(spark.read.schema(_JOURNAL).parquet(f"{journal}/round={len(rows)}").first())
    return rows


def fit_rounds(v, evaluate, save, threshold: float = STORE_THRESHOLD, factor: float = PLATEAU_FACTOR,
               patience: int = PLATEAU_PATIENCE, least_scale: float = LEAST_SCALE, journal: str | None = None):
    """Fit-evaluate rounds of prototypes until the plateau rule has brought the step size below ``least_scale``.

    A round moves each prototype by ``scale`` towards the mean of the vectors assigned to it. ``patience`` rounds without a
    smaller loss, and one more, multiply ``scale`` by ``factor``. ``evaluate(protos)`` gives (loss, acc); ``save(protos, round)``
    is called when acc is strictly above ``threshold``. Returns (round, loss, acc, saved, scale) of each round.

    With a ``journal`` folder each round ends with a record of it, committed after the prototypes of the next round are
    written, so a fit that was cut off goes on after its last full round, with the same result. ``save`` of a round
    that is done again is called again.
    """
    spark = v.sparkSession
    best, bad, scale, rows = float("inf"), 0, 1.0, []
    done = journal_rounds(spark, journal) if journal else []
    for r in done:
        best, bad, scale = r["best"], r["bad"], r["scale"]
        rows.append((r["round"], r["loss"], r["acc"], r["saved"], r["scale"]))
    # k rows: cut the lineage each round
    protos = spark.read.parquet(done[-1]["next_path"]) if done else materialize(assign.class_mean_prototypes(v), "prototypes-fit0")
    while scale >= least_scale:
        r = len(rows)
        loss, acc = evaluate(protos)
        if acc > threshold:
            save(protos, r)
        best, bad = (loss, 0) if loss < best else (best, bad + 1)
        if bad > patience:
            scale, bad = scale * factor, 0
        rows.append((r, loss, acc, acc > threshold, scale))
        scored = assign.assign_to_prototypes(v, protos).select(F.col("pred").alias("q"), "x")
        new = assign.mean_vectors(scored, ["q"], "x", "c_new")
        moved = F.zip_with("c", "c_new", lambda a, b: a + F.lit(scale) * (b - a))
        after = protos.join(new, "q", "left").select("q", F.coalesce(moved, F.col("c")).alias("c"))
        if journal:
            path = f"{journal}/prototypes/round={r + 1}"
            after.write.mode("overwrite").parquet(path)
            record = (r, loss, acc, acc > threshold, scale, best, bad, path)
            spark.createDataFrame([record], _JOURNAL).coalesce(1).write.mode("overwrite").parquet(f"{journal}/round={r}")
            protos = spark.read.parquet(path)
        else:
            protos = materialize(after, f"prototypes-fit{r + 1}")
    return rows


@query("fit_loop")
def fit_loop(spark, sf_dir):
    """K5: fit-evaluate rounds with metric-gated save and plateau rule (factor 0.5, patience 2), one row a round;
    ``best`` marks the round with the smallest loss."""
    v = tables.vectors(spark, sf_dir)
    # batches are the same in every round
    batched = materialize(_batched(v), "fit-batches")

    def evaluate(protos):
        m = _batch_acc(batched, protos).first()
        return float(m["loss"]), float(m["acc_batch_mean"])

    rows = fit_rounds(v, evaluate, lambda protos, r: protos.write.parquet(stage_path(spark, f"prototypes-round{r}")),
                      journal=stage_path(spark, "fit-journal"))
    least = min(row[1] for row in rows)
    return spark.createDataFrame([(*row, row[1] == least) for row in rows],
                                 "round int, loss double, acc_batch_mean double, saved boolean, lr_scale double, best boolean")


_TOKS = ("tc AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(CASE WHEN length(trim(text)) = 0 "
         "THEN []::VARCHAR[] ELSE string_split_regex(trim(text), '\\s+') END) AS term FROM documents) GROUP BY ALL)")
_UNIT = ("SELECT doc_id, count(*) AS n_terms, round(sum(w / n), 6) AS weight_sum, round(max(w / n), 6) AS weight_max, "
         "round(sum((w / n) * length(term)), 6) AS by_length FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS n "
         "FROM wt) WHERE n > 0 GROUP BY doc_id")


def _per_document(vectors):
    """Figures of each document that every weight takes part in."""
    return vectors.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("weight").alias("weight_sum"), F.max("weight").alias("weight_max"),
        F.sum(F.col("weight") * F.length("term")).alias("by_length"))


@query("embed_text", f"WITH {_TOKS}, df AS (SELECT term, count(*) AS df FROM tc GROUP BY term), "
       "wt AS (SELECT doc_id, term, tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) AS w FROM tc JOIN df USING (term)) "
       + _UNIT)
def embed_text(spark, sf_dir):
    """Text -> sparse vector with the ``tfidf`` encoder (long form, unit length); figures of each document."""
    return _per_document(encode(tables.table(spark, sf_dir, "documents"), "tfidf"))


@query("embed_text_tf", f"WITH {_TOKS}, wt AS (SELECT doc_id, term, CAST(tf AS DOUBLE) AS w FROM tc) " + _UNIT)
def embed_text_tf(spark, sf_dir):
    """The ``tf`` encoder chosen by name."""
    return _per_document(encode(tables.table(spark, sf_dir, "documents"), "tf"))


def _projected_sql(weights: str) -> str:
    """CTEs sl, ex (doc_id, x): the sparse sign projection of ``weights`` (doc_id, term, w), unit length."""
    return (f"un AS (SELECT doc_id, term, w / n AS w FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS n FROM {weights}) WHERE n > 0), "
            f"sl AS (SELECT doc_id, w, md5(term || ':' || m) AS h FROM un, (SELECT unnest(range({SLOTS})) AS m)), "
            f"pv AS (SELECT doc_id, ('0x' || substr(h, 1, 8))::BIGINT % {DIM} AS pos, "
            f"sum(CASE WHEN substr(h, 9, 1) >= '8' THEN w ELSE -w END) / sqrt({SLOTS}.0) AS v FROM sl GROUP BY ALL), "
            f"ex AS (SELECT i.doc_id, list(coalesce(v, 0.0) ORDER BY i.pos) AS x FROM (SELECT doc_id, unnest(range({DIM})) AS pos FROM "
            "(SELECT DISTINCT doc_id FROM pv)) i LEFT JOIN pv ON pv.doc_id = i.doc_id AND pv.pos = i.pos GROUP BY i.doc_id)")


_TFIDF = (f"{_TOKS}, df AS (SELECT term, count(*) AS df FROM tc GROUP BY term), "
          "wt AS (SELECT doc_id, term, tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) AS w FROM tc JOIN df USING (term))")


@query("embed_text_dense", f"WITH {_TFIDF}, {_projected_sql('wt')} SELECT doc_id, CAST(unnest(range({DIM})) AS INTEGER) AS pos, "
       "round(unnest(x), 6) AS value FROM ex")
def embed_text_dense(spark, sf_dir):
    """Text -> dense vector of fixed length with the ``tfidf_projected`` encoder (long form)."""
    x = embed(tables.table(spark, sf_dir, "documents"), "tfidf_projected")
    return x.select("doc_id", F.posexplode("x").alias("pos", "value"))


_TEXT_BASE = [DOCS, _TFIDF, _projected_sql("wt"), "vecs AS (SELECT ex.doc_id AS id, ex.x, docs.class_index AS label FROM ex JOIN docs USING (doc_id))",
              S.class_mean_protos(), f"pred AS ({S.nearest_by_cos('vecs')})"]


@query("evaluate_texts", S.with_ctes(
    _TEXT_BASE + ["cont AS (SELECT 0 AS g, pred, label, count(*) AS n_ij FROM pred GROUP BY pred, label)"]
    + S.dp_best("(SELECT g, pred AS r, label AS c, n_ij AS v FROM cont)") + S.agreement("cont"), S.report_select(), recursive=True))
def evaluate_texts(spark, sf_dir):
    """F8 -> K6: texts in, metrics out: documents -> dense vectors -> class-mean prototypes -> cosine argmax -> report."""
    corpus = tables.text_corpus(spark, sf_dir).select("doc_id", "class_index", F.col("description").alias("text"))
    x = embed(corpus.select("doc_id", "text"), "tfidf_projected")
    v = materialize(x.join(corpus.select("doc_id", F.col("class_index").alias("label")), "doc_id").select(
        F.col("doc_id").alias("id"), "x", "label"), "text-vectors")
    scored = assign.assign_to_prototypes(v, assign.class_mean_prototypes(v), pred_only=True)
    return metrics.clustering_report(scored.select("pred", "label"))


# fixed value: parts that the state query keeps apart
STATE_PARTS = 3


@query("metrics_state_report", f"SELECT r.*, l.loss FROM ({REPORT_SQL}) r, "
       f"({S.with_ctes(_CE, 'SELECT round(avg(loss), 6) AS loss FROM ce')}) l")
def metrics_state_report(spark, sf_dir):
    """Pooled metrics and loss merged from the saved states of three parts; the rows are read once a part."""
    scored = scored_vectors(spark, sf_dir)
    parts = scored.withColumn("part", (F.col("id") % STATE_PARTS).cast("int"))
    path = stage_path(spark, "metric-states")
    for p in range(STATE_PARTS):
        own = parts.where(F.col("part") == p)
        metrics.save_state(metrics.metric_state(own, "part", cross_entropy_double_softmax(own)), path, "part")
    return metrics.report_from_state(metrics.merge_states(spark.read.parquet(path)))
