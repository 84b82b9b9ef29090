"""Retrieval and prediction benchmarks: leave-one-group-out ranks and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandforge.functions.text import hit_at
from strandforge.lineage import cut
from strandforge.operators.curation import anchor_loci
from strandforge.operators.ordered import exact_medians
from strandforge.operators.orf import orfs, with_protein
from strandforge.operators.rules import Rule, best_rule_score, dealt, predicted_and_known, reasons
from strandforge.operators.similarity import best_by_locus, top_loci


def holdout_scores(candidates: DataFrame, references: DataFrame) -> DataFrame:
    """Each candidate's best similarity to references of other groups than its own, by matrix products.

    ``candidates``: candidate_id, group, embedding; ``references``: ref_id, group, ref_ord, embedding.
    """
    best = best_by_locus(candidates, references.withColumnRenamed("group", "locus"))
    own = candidates.select("candidate_id", F.col("group").cast("string").alias("group"))
    return best.join(own, "candidate_id").filter(F.col("locus") != F.col("group")).groupBy("candidate_id").agg(F.max("similarity").alias("best_similarity"))


def without_same_sequence(references: DataFrame, held_out: DataFrame) -> DataFrame:
    """The strict reference set: also without sequences that are held out under another accession."""
    return references.join(held_out.select("sequence").distinct(), "sequence", "left_anti")


def holdout_ranks(scored: DataFrame, cutoffs: dict[str, float] | None = None, decimals: int = 9) -> DataFrame:
    """Rank of each locus's held-out candidates, also among those that pass a rule cutoff; one row a locus.

    ``scored``: locus, candidate_id, best_similarity, is_holdout, [rule_score].  Equal similarities (to ``decimals``) rank by id.
    """
    order = Window.partitionBy("locus").orderBy(F.round("best_similarity", decimals).desc(), "candidate_id")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = scored.withColumn("_rank", F.row_number().over(order))
    names = {}
    for name, least in (cutoffs or {}).items():
        ok = F.coalesce(F.col("rule_score") >= least, F.lit(False))
        ranked = ranked.withColumn(f"_{name}", F.when(ok, F.sum(ok.cast("int")).over(running)))
        names[name] = F.min(F.when(F.col("is_holdout"), F.col(f"_{name}"))).alias(name)
    top = lambda k: F.max(F.when(F.col("_rank") == k, F.col("best_similarity")))
    return ranked.groupBy("locus").agg(
        F.min(F.when(F.col("is_holdout"), F.col("_rank"))).alias("rank"), *names.values(), F.count("*").alias("candidate_count"), F.count_if("is_holdout").alias("holdout_match_count"), (top(1) - top(2)).alias("top1_top2_gap"),
    )


def recall(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 50), rank: str = "rank") -> DataFrame:
    """One row of recall at each k (no rank counts as a miss), and the candidate counts' mean, median, least and most.

    ``ranks`` is written once; the median is exact and gathers in no task.
    """
    ranks = cut(ranks)
    row = ranks.agg(
        F.count("*").alias("loci"), *(F.avg(hit_at(F.col(rank), k).cast("double")).alias(f"recall_{k}") for k in ks),
        F.avg("candidate_count").alias("candidates_mean"), F.min("candidate_count").alias("candidates_min"), F.max("candidate_count").alias("candidates_max"),
    )
    return row.join(exact_medians(ranks, [], "candidate_count", "candidates_median"), how="left")  # one row each


def sequence_recall(ranks: DataFrame, sequences: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 50)) -> DataFrame:
    """Recall by sequence: each takes the best rank among its loci."""
    best = sequences.join(ranks, "locus", "left").groupBy("sequence").agg(F.min("rank").alias("rank"))
    return best.agg(F.count("*").alias("sequences"), *(F.avg(hit_at(F.col("rank"), k).cast("double")).alias(f"recall_{k}") for k in ks))


def core_ranks(predictions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rank of the true core among a candidate's predicted ones, with I and L alike; null where it isn't among them.

    ``predictions``: candidate_id, rank, core; ``candidates``: candidate_id, case_id, core_group, core_aa.
    """
    same = lambda c: F.translate(F.upper(c), "I", "L")
    hit = F.when((F.length("core_aa") > 0) & (same(F.col("core")) == same(F.col("core_aa"))), F.col("rank"))
    return candidates.join(predictions.select("candidate_id", "rank", "core"), "candidate_id", "left").groupBy("candidate_id", "case_id", "core_group").agg(F.min(hit).alias("rank"))


def core_topk(ranks: DataFrame, by: str | None = None, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Share of candidates, or of groups by their best rank, within each k."""
    own = ranks if by is None else ranks.groupBy(by).agg(F.min("rank").alias("rank"))
    return own.agg(F.count("*").alias("n"), *(F.avg(hit_at(F.col("rank"), k).cast("double")).alias(f"top_{k}") for k in ks))


def core_summary(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row: how many candidates, groups and cases there are, and at each level the share within each k (``candidate_top_1`` and so on).

    A group and a case count by their best rank.  Levels are made distinct as keys before they are counted.
    """
    out = None
    for name, by in (("candidate", None), ("group", "core_group"), ("case", "case_id")):
        own = core_topk(ranks, by, ks)
        own = own.select(F.col("n").alias({"candidate": "candidates", "group": "groups", "case": "cases"}[name]), *(F.col(f"top_{k}").alias(f"{name}_top_{k}") for k in ks))
        out = own if out is None else out.join(own, how="cross")  # one row each
    return out


def core_benchmark(candidates: DataFrame, variants: dict[str, dict[str, Rule]], top_n: int = 5, allow_inverted: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, cases, misses) of the core predictor on candidates with a given core, under each rule set.

    ``candidates``: candidate_id, case_id, core_group, core_aa, protein_sequence; those without a core or protein aren't judged.  ``summary``: a row a
    variant with ``core_summary``; ``cases``: a row a candidate with the true core's rank among the ``top_n`` (null: none) and the best prediction;
    ``misses``: the candidates whose best prediction isn't the true core, with why: the true core's own rank and score among all allowed
    sites, and its reasons and those of the prediction, or ``true_status`` ``not in protein`` or ``site not allowed``.  Each
    distinct protein's sites are scored once a variant.
    """
    same = lambda c: F.translate(F.upper(F.trim(c)), "I", "L")
    known = candidates.withColumns({"protein_sequence": F.upper(F.trim("protein_sequence")), "core_aa": F.upper(F.trim("core_aa"))}).filter("protein_sequence <> '' and core_aa <> ''")
    known = cut(known.select("candidate_id", "case_id", "core_group", "core_aa", "protein_sequence"))
    end = F.endswith(same(F.col("sequence")), F.col("c"))
    at_end = end | F.startswith(same(F.col("sequence")), F.col("c")) if allow_inverted else end
    cores = known.select(F.col("protein_sequence").alias("sequence"), same(F.col("core_aa")).alias("c")).distinct()
    # what ends (or begins) a protein: at most twice its length
    wanted = cores.groupBy("sequence").agg(F.collect_list(F.when(at_end, F.col("c"))).alias("cores"))
    proteins = cut(dealt(wanted, "sequence"))
    every, wrong = None, None
    for name, own_rules in variants.items():
        told = predicted_and_known(proteins, own_rules, allow_inverted)
        site = F.struct("rank", F.round("score", 6).alias("score"), "orientation", "position", "core", F.array_join(reasons(F.col("score_breakdown")), "; ").alias("reasons"))
        ranked = cut(told.select("sequence", site.alias("s")))
        best = ranked.filter("s.rank = 1").select("sequence", F.col("s").alias("best"))
        cores = known.select(F.col("protein_sequence").alias("sequence"), "core_aa").distinct()
        true = ranked.join(cores, "sequence").filter(same(F.col("s.core")) == same(F.col("core_aa"))).groupBy("sequence", "core_aa").agg(F.min("s").alias("true"))
        found = known.withColumnRenamed("protein_sequence", "sequence").join(best, "sequence", "left").join(true, ["sequence", "core_aa"], "left")
        found = found.withColumn("variant", F.lit(name)).withColumn("rank", F.when(F.col("true.rank") <= top_n, F.col("true.rank")))
        cases = found.select("variant", "candidate_id", "case_id", "core_group", "core_aa", F.col("sequence").alias("protein_sequence"), "rank", F.col("best.core").alias("best_core"), F.col("best.position").alias("best_position"), F.col("best.score").alias("best_score"), F.col("best.orientation").alias("best_orientation"))
        status = F.when(~F.contains(same(F.col("sequence")), same(F.col("core_aa"))), "not in protein").when(F.col("true").isNull(), "site not allowed").otherwise("outranked")
        missed = found.filter(F.coalesce(F.col("true.rank") > 1, F.lit(True))).select(
            "variant", "candidate_id", "case_id", "core_group", "core_aa", F.col("best.core").alias("best_core"), F.col("best.position").alias("best_position"), F.col("best.score").alias("best_score"), F.col("best.reasons").alias("best_reasons"),
            status.alias("true_status"), F.col("true.rank").alias("true_rank"), F.col("true.position").alias("true_position"), F.col("true.score").alias("true_score"), F.col("true.reasons").alias("true_reasons"),
        )
        every = cases if every is None else every.unionByName(cases)
        wrong = missed if wrong is None else wrong.unionByName(missed)
    every = cut(every)
    summary = None
    for name in variants:
        own = core_summary(every.filter(F.col("variant") == name)).withColumn("variant", F.lit(name))
        summary = own if summary is None else summary.unionByName(own)
    return summary, every, wrong


def retrieval_benchmark(
    records: DataFrame, cds: DataFrame, references: DataFrame, embeddings: DataFrame, flank: int = 20_000, full_genome: bool = False, strict: bool = False,
    cutoffs: dict[str, float] | None = None, rules: dict[str, Rule] | None = None, min_aa: int = 20, max_aa: int = 120,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranks by locus, held-out candidates, summary): every anchored locus against the references of other accessions.

    ``records``: gbk_path, record_id, sequence; ``cds``: gbk_path, record_id, start, end, accession; ``references``: accession, sequence,
    ref_id, ref_ord, embedding; ``embeddings``: protein, embedding.  A locus is a coding sequence of a reference's accession with ``flank`` bases
    around it, or with ``full_genome`` its whole record.  It is judged if some open frame of it is a reference of its accession;
    those references are held out (with ``strict`` their sequences under any accession).  A candidate counts by its best similarity to the others,
    of which only the two best accessions of a protein are kept, so no locus meets every reference.
    """
    cutoffs = {"rank_rule7": 7.0, "rank_rule8": 8.0} if cutoffs is None else cutoffs
    refs = cut(references.withColumn("sequence", F.upper("sequence")))  # read by every later step
    # a whole record: a flank that no record has
    loci = anchor_loci(cds, refs.select("accession").distinct(), records, 1_000_000_000 if full_genome else flank)
    named = loci.withColumn("locus", F.concat_ws(":", "gbk_path", "record_id", F.col("start").cast("string"), F.col("end").cast("string"), "accession"))
    found = with_protein(orfs(named, min_aa, max_aa)).withColumn("candidate_id", F.concat_ws(":", "strand", F.col("genomic_start").cast("string"), F.col("genomic_end").cast("string")))
    held = refs.select("accession", F.col("sequence").alias("protein")).distinct().withColumn("_held", F.lit(True))
    marked = found.join(held, ["accession", "protein"], "left").withColumn("is_holdout", F.coalesce("_held", F.lit(False))).drop("_held")
    judged = marked.filter("is_holdout").select("locus").distinct()
    own = cut(marked.join(judged, "locus", "left_semi").select("locus", "accession", "candidate_id", "protein", "is_holdout"))
    usable = without_same_sequence(refs, own.filter("is_holdout").select(F.col("protein").alias("sequence"))) if strict else refs
    vectors = embeddings.join(own.select("protein").distinct(), "protein").select(F.col("protein").alias("candidate_id"), "embedding")
    # the references' names are not asked for, so they don't travel
    two = top_loci(vectors, usable.select(F.lit("").alias("ref_id"), F.col("accession").alias("locus"), "ref_ord", "embedding"), 2).select(F.col("candidate_id").alias("protein"), F.col("best").alias("two"))
    other = F.filter("two", lambda x: x["locus"] != F.col("accession"))
    scored = own.join(two, "protein").withColumn("best_similarity", F.try_element_at(other, F.lit(1))["similarity"]).filter("best_similarity is not null").drop("two")
    # of what is written: what has been searched for is read once
    raw = best_rule_score(own.select(F.col("protein").alias("sequence")), rules).select(F.col("sequence").alias("protein"), F.col("rule_score_raw").alias("rule_score"))
    scored = cut(scored.join(raw, "protein"))
    ranks = cut(holdout_ranks(scored, cutoffs))
    held_out = scored.filter("is_holdout").join(ranks.select("locus", "rank", *cutoffs), "locus")
    sequences = held_out.select(F.col("protein").alias("sequence"), "locus").distinct()
    totals = [named.select("locus").distinct().agg(F.count("*").alias("loci_total")), recall(ranks), sequence_recall(ranks, sequences).withColumnsRenamed({f"recall_{k}": f"sequence_recall_{k}" for k in (1, 5, 10, 50)})]
    return ranks, held_out, totals[0].crossJoin(totals[1]).crossJoin(totals[2])  # one row each
