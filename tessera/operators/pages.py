"""Per-page article matching: cost tables between predicted articles (prototypes q)
and true articles (labels j), optimal matching per page, and masked L1 sums.

Cost decomposition (avoids a paragraphs x q x j expansion):
  sum_para |cos_q - y_j|, y_j = +1 if label = j else -1
    = sum_para |cos_q + 1|  +  sum_{para: label = j} (|cos_q - 1| - |cos_q + 1|)
so one ``groupBy(page, q)`` and one ``groupBy(page, q, label)`` give every cell.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V

# fixed value: weight of padding (absent) articles in the class term
NO_ARTICLE_WEIGHT = 0.1


def long_scores(scored_pages: DataFrame) -> DataFrame:
    """(page, para, label, pred, q, c, p) with p = softmax over q of the paragraph's cosines."""
    s = scored_pages.withColumn("_p", V.softmax("cos"))
    return s.select("page", "para", "label", "pred",
                    F.explode(F.arrays_zip("qs", "cos", "_p")).alias("t")) \
        .select("page", "para", "label", "pred", F.col("t.qs").alias("q"), F.col("t.cos").alias("c"),
                F.col("t._p").alias("p"))


def cost_table(scored_pages: DataFrame, term: str = "cos") -> DataFrame:
    """(page, q, j, match_cost, class_cost, cost) for each predicted article q and each true article j OF THE PAGE.

    term = "cos": match_cost = sum_para |cos - (+-1)|;
    term = "para": match_cost = sum_para |softmax_q - 1[label = j]|.
    class_cost = 2 |share of paragraphs predicted q - 1[j present in page]|.
    ``absent_cost`` is the cost of q against any article that the page does not have (they all cost the same),
    which pads the matching of a page to a square.
    """
    long = long_scores(scored_pages)
    if term == "cos":
        base, delta = F.abs(F.col("c") + 1), F.abs(F.col("c") - 1) - F.abs(F.col("c") + 1)
    else:
        base, delta = F.col("p"), F.lit(1.0) - 2 * F.col("p")
    # one pass over the paragraphs; the sums over a page's articles give the rest
    b = long.groupBy("page", "q", F.col("label").alias("j")).agg(
        F.sum(base).alias("_sb"), F.sum(delta).alias("_b"),
        F.sum(F.when(F.col("pred") == F.col("q"), 1).otherwise(0)).alias("_np"), F.count(F.lit(1)).alias("_n"))
    of_q = Window.partitionBy("page", "q")
    b = (b.withColumn("_a", F.sum("_sb").over(of_q))
         .withColumn("p_q", F.sum("_np").over(of_q) / F.sum("_n").over(of_q)))
    match, cls = F.col("_a") + F.col("_b"), 2 * F.abs(F.col("p_q") - 1.0)
    return b.where(F.col("j").isNotNull()).select(
        "page", "q", "j", match.alias("match_cost"), cls.alias("class_cost"), (match + cls).alias("cost"), "p_q",
        F.col("_a").alias("absent_match"), (F.col("_a") + 2 * F.col("p_q")).alias("absent_cost"))


def article_shape(pages: DataFrame) -> DataFrame:
    """(page, n_articles, n_paras): the true shape of each page."""
    return pages.groupBy("page").agg(F.countDistinct("label").alias("n_articles"), F.count(F.lit(1)).alias("n_paras"))


def valid_mask(shape: DataFrame, most_paras: int) -> DataFrame:
    """``shape`` with one row for each of ``most_paras`` paragraph slots: ``para`` and ``valid`` (1 inside the page)."""
    return shape.withColumn("para", F.explode(F.sequence(F.lit(0), F.lit(most_paras - 1)))).withColumn(
        "valid", (F.col("para") < F.col("n_paras")).cast("int"))


def article_weights(scored_pages: DataFrame, slots: int) -> DataFrame:
    """(page, slot, weight) of ``slots`` article slots a page (more if it has more): 1 for its real articles, 0.1 for padding."""
    shape = article_shape(scored_pages)
    return shape.select("page", "n_articles", F.explode(F.sequence(
        F.lit(0), F.greatest(F.lit(slots), F.col("n_articles").cast("int")) - 1)).alias("slot")).select(
        "page", "slot", F.when(F.col("slot") < F.col("n_articles"), F.lit(1.0)).otherwise(
            F.lit(NO_ARTICLE_WEIGHT)).alias("weight"))


def matched_l1(costs: DataFrame, para_costs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Masked L1 sums after matching, per page. ``pairs`` includes the padded ones (null j).

    class_l1 = sum over matched (q, j) of class_cost x weight, weight 1 for real articles and 0.1 for padding;
    para_l1 = sum of the paragraph costs; cos_l1 = sum of the cosine costs over rows whose article score beats
    the no-article score (p_q > 1 - p_q).
    """
    of_q = costs.groupBy("page", "q").agg(F.first("p_q").alias("_p"), F.first("absent_match").alias("_cos0"))
    para_q = para_costs.groupBy("page", "q").agg(F.first("absent_match").alias("_para0"))
    m = (pairs.join(of_q, ["page", "q"]).join(para_q, ["page", "q"])
         .join(costs.select("page", "q", "j", "match_cost", "class_cost"), ["page", "q", "j"], "left")
         .join(para_costs.select("page", "q", "j", F.col("match_cost").alias("para_cost")), ["page", "q", "j"], "left"))
    real = F.col("j").isNotNull()
    return m.groupBy("page").agg(
        F.sum(F.when(real, F.col("class_cost")).otherwise(2 * F.col("_p") * NO_ARTICLE_WEIGHT)).alias("class_l1"),
        F.sum(F.when(real, F.col("para_cost")).otherwise(F.col("_para0"))).alias("para_l1"),
        F.sum(F.when(F.col("_p") > 1 - F.col("_p"), F.when(real, F.col("match_cost")).otherwise(F.col("_cos0")))
              .otherwise(0.0)).alias("cos_l1"))
