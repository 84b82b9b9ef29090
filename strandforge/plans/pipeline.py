"""From segments to ranked candidates: one plan, of which only known sequences (and, with a model, the frames) are written in between."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandforge.lineage import cut
from strandforge.operators.index import build_index, lookup_genomes
from strandforge.operators.orf import indexed_regions, orfs, region_orfs, windows_of, with_candidate_ids, with_protein
from strandforge.operators.rank import rank_candidates
from strandforge.operators.rules import Rule, predict
from strandforge.operators.similarity import score_candidates
from strandforge.plans.embed import Model, embed
from strandforge.plans.progress import Progress


@dataclass(frozen=True)
class Config:
    min_aa: int = 20
    max_aa: int = 120
    top_n: int = 5
    score_mode: str = "top_n_mean"
    min_rule_score: float = 0.0
    allow_inverted: bool = False
    target_only: bool = False
    restrict: bool = False

    def __post_init__(self):
        if self.score_mode not in ("best_similarity", "top_n_mean") or self.min_rule_score < 0:
            raise ValueError("no such score mode, or a negative cutoff")


def extract_candidates(segments: DataFrame, config: Config) -> DataFrame:
    own = segments
    if config.target_only:
        own = segments.filter("is_target")
        if own.isEmpty():
            raise ValueError("no target segment is left")
    windows = windows_of(own, config.restrict).select("record_id", "sequence", "window_start")
    return with_candidate_ids(with_protein(orfs(windows, config.min_aa, config.max_aa)))


def holds_any(text: Column, words: list[str]) -> Column:
    """Whether one of some short words stands in the text: a look at every place of it for each length, however many words there are."""
    held = {n: {w for w in words if len(w) == n} for n in {len(w) for w in words}}

    def found(s: pa.Array) -> pa.Array:
        return pa.array([x is not None and any(x[i : i + n] in own for n, own in held.items() for i in range(len(x) - n + 1)) for x in s.to_pylist()], pa.bool_())

    return F.arrow_udf(found, "boolean")(text) if held else F.lit(False)


#: Lengths of what leads a reference: the longest that it has.
LEADS = (10, 12, 15, 20, 30, 50, 80)


def leading_stretches(text: Column, widths: list[int], gram: int) -> Column:
    """Of every window of each width its stretch of ``gram`` letters with the least hash, once a text.

    Equal windows have equal ones, and neighbouring windows mostly share theirs, so they are few beside all stretches.
    """

    def found(s: pa.Array) -> pa.Array:
        texts = [x or "" for x in s.to_pylist()]
        whole = "".join(texts)
        letters = np.frombuffer(whole.encode("utf-32-le"), "<u4").astype(np.uint64)
        ends = np.cumsum([0, *map(len, texts)])
        hashes = np.zeros(max(0, len(letters) - gram + 1), np.uint64)
        for k in range(gram):
            hashes = (hashes + letters[k : k + len(hashes)]) * np.uint64(0x9E3779B97F4A7C15)
            hashes ^= hashes >> np.uint64(29)
        end_of = np.repeat(ends[1:], np.diff(ends))
        at = [np.zeros(0, int)]
        for width in widths:
            n = width - gram + 1
            if len(hashes) >= n:
                windows = np.lib.stride_tricks.sliding_window_view(hashes, n)
                starts = np.flatnonzero(np.arange(len(windows)) + width <= end_of[: len(windows)])  # within one text
                for k in range(0, len(starts), 1 << 16):
                    at.append(starts[k : k + (1 << 16)] + np.argmin(windows[starts[k : k + (1 << 16)]], axis=1))
        at = np.unique(np.concatenate(at))
        bounds = np.searchsorted(at, ends).tolist()
        at = at.tolist()
        return pa.array([list({whole[i : i + gram] for i in at[a:b]}) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.list_(pa.string()))

    return F.arrow_udf(found, "array<string>")(text)


def mark_known(candidates: DataFrame, references: DataFrame, most: int = 5000, gram: int = 8, pairs: int = 1_000_000) -> DataFrame:
    """is_known_precursor: some reference sequence stands within the protein.

    Up to ``most`` references are tried in place: those of at most ``gram`` residues by looking up each stretch of a protein, longer ones
    one by one.  A null protein holds none.  More of them meet the distinct proteins by the stretch of ``gram`` residues that leads
    them: the one with the least hash of their first residues, of which a protein has few.  A stretch that would bring more than
    ``pairs`` pairs together is too common for that; its references, and those shorter than ``gram``, meet the proteins by their rarest one.
    """
    refs = references.select(F.upper("sequence").alias("r")).filter("r <> ''").distinct()
    listed = cut(refs)
    if listed.count() <= most:
        short, long = F.length("r") <= gram, F.length("r") > gram
        row = listed.agg(F.collect_list(F.when(short, F.col("r"))).alias("short"), F.collect_list(F.when(long, F.col("r"))).alias("long"))  # at most ``most`` strings, one row
        known, out = holds_any(F.col("protein"), row.first().short), candidates
        if not listed.filter(long).isEmpty():
            out = candidates.join(F.broadcast(row.select(F.col("long").alias("_refs"))), how="cross")
            known = known | F.coalesce(F.exists("_refs", lambda r: F.contains(F.col("protein"), r)), F.lit(False))
        return out.withColumn("is_known_precursor", known).drop("_refs")

    proteins = candidates.select("protein").distinct()
    own = listed.withColumn("_n", F.length("r")).filter(F.col("_n") >= gram)
    width = F.lit(gram)
    for n in LEADS:
        width = F.when(F.col("_n") >= n, n).otherwise(width) if n > gram else width
    own = own.select("r", F.left("r", width).alias("lead"))
    widths = sorted(r[0] for r in own.select(F.length("lead")).distinct().collect())  # some of LEADS, and gram
    rest, known = listed, None
    if widths:
        by_width = [own.filter(F.length("lead") == n).select("r", leading_stretches(F.col("lead"), [n], gram)[0].alias("g")) for n in widths]
        leads = cut(reduce(DataFrame.union, by_width))
        hits = cut(proteins.select("protein", F.explode(leading_stretches(F.col("protein"), widths, gram)).alias("g")).join(leads.select("g").distinct(), "g"))
        common = cut(hits.groupBy("g").agg(F.count("*").alias("n")).join(leads.groupBy("g").agg(F.count("*").alias("m")), "g").filter(F.col("n") * F.col("m") > pairs).select("g"))
        known = hits.join(leads.join(common, "g", "left_anti"), "g").filter(F.contains("protein", F.col("r"))).select("protein")
        rest = leads.join(common, "g").select("r").union(listed.filter(F.length("r") < gram).select("r"))
    if not rest.isEmpty():
        rarest = _by_rarest(proteins, cut(rest), gram)
        known = rarest if known is None else known.union(rarest)
    return candidates.join(known.distinct().withColumn("_known", F.lit(True)), "protein", "left").withColumn("is_known_precursor", F.coalesce("_known", F.lit(False))).drop("_known")


def _by_rarest(proteins: DataFrame, listed: DataFrame, gram: int) -> DataFrame:
    """The proteins that hold a listed sequence, by its stretch of ``gram`` residues that the fewest proteins have.

    A reference with a stretch that none has is done with, and a common stretch brings references to proteins only where all of
    theirs are common.  Shorter references are their own stretch.
    """

    def stretches(text: str, n: int) -> Column:
        places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(n))))

    sizes = sorted(r[0] for r in listed.select(F.least(F.length("r"), F.lit(gram))).distinct().collect())  # at most ``gram`` numbers
    own = F.when(F.length("r") >= gram, stretches("r", gram)).otherwise(F.array("r"))
    wanted = listed.select("r", F.explode(own).alias("g"))
    grams = proteins.select("protein", F.explode(F.flatten(F.array(*(stretches("protein", n) for n in sizes)))).alias("g"))
    hits = cut(grams.join(wanted.select("g").distinct(), "g"))
    counts = hits.groupBy("g").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "g", "left").groupBy("r").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("b")).filter("b.n > 0").select("r", F.col("b.g").alias("g"))
    return hits.join(rarest, "g").filter(F.contains("protein", F.col("r"))).select("protein")


def checked_join(candidates: DataFrame, scores: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Every candidate with its scores; a candidate without is an error."""
    out = candidates.join(scores, key, "left")
    sound = F.when(F.col("best_similarity").isNull(), F.raise_error(F.concat(F.lit("no score for "), F.col("candidate_id").cast("string"))).cast("double")).otherwise(F.col("best_similarity"))
    return out.withColumn("best_similarity", sound)


def run_pipeline(segments: DataFrame, embeddings: DataFrame, references: DataFrame, config: Config | None = None, index: DataFrame | None = None, rules: dict[str, Rule] | None = None, progress: Progress | None = None) -> DataFrame:
    """Segments, an embedding by distinct protein, and labelled references to ranked candidates.

    ``embeddings``: protein, embedding (made by any model); ``references``: ref_id, locus, ref_ord, embedding, sequence.  Distinct vectors are
    scored once and joined back, however many proteins share one.  ``progress`` counts the rows of each stage while the plan runs.
    """
    config = config or Config()
    count = progress.stage if progress else lambda df, *_: df
    found = count(extract_candidates(count(segments, 1, "{rows} segments"), config), 2, f"{{rows}} candidates of {config.min_aa} to {config.max_aa} residues in six frames")
    embeddings = count(embeddings, 3, "{rows} distinct proteins embedded")
    vectors = embeddings.select(F.col("embedding").alias("candidate_id")).distinct().withColumn("embedding", F.col("candidate_id"))
    scores = embeddings.join(score_candidates(vectors, references, config.top_n), F.col("embedding") == F.col("candidate_id")).drop("embedding", "candidate_id")
    return _ranked(found, scores, references, config, index, rules, count)


def run_embedded_pipeline(segments: DataFrame, references: DataFrame, load: Callable[[], Model], name: str, config: Config | None = None, index: DataFrame | None = None, rules: dict[str, Rule] | None = None, progress: Progress | None = None, **batching: int) -> DataFrame:
    """From sequences to ranks: ``run_pipeline`` with embeddings of candidates and references by the model that ``load`` gives.

    ``references``: ref_id, locus, ref_ord, sequence.  Distinct sequences are embedded once, and what the model gives is written, as it is
    counted before it is compared.
    """
    config = config or Config()
    count = progress.stage if progress else lambda df, *_: df
    # written once: the model's input and the ranking's rows come from the same frames
    found = cut(count(extract_candidates(count(segments, 1, "{rows} segments"), config), 2, f"{{rows}} candidates of {config.min_aa} to {config.max_aa} residues in six frames"))
    vectors = cut(count(embed(found, load, name, **batching), 3, "{rows} distinct proteins embedded"))
    references = cut(references)
    known = cut(references.join(embed(references, load, name, "sequence", **batching), "sequence"))
    scores = score_candidates(vectors.withColumnRenamed("protein", "candidate_id"), known, config.top_n).withColumnRenamed("candidate_id", "protein")
    return _ranked(found, scores, known, config, index, rules, count)


def _ranked(found: DataFrame, scores: DataFrame, references: DataFrame, config: Config, index: DataFrame | None, rules: dict[str, Rule] | None, count: Callable[..., DataFrame]) -> DataFrame:
    scored = count(checked_join(found, scores, "protein"), 4, "{rows} candidates scored")
    ranked = rank_candidates(scored.withColumn("ord", F.col("candidate_id")), "record_id", config.score_mode, config.min_rule_score, rules, config.allow_inverted)
    return count(lookup_genomes(mark_known(count(ranked, 5, "{rows} candidates ranked"), references), index), 6, "{rows} results")


def index_pipeline(records: DataFrame, features: DataFrame, word: str, **limits) -> DataFrame:
    """Occurrence index of the open frames of the regions and clusters whose product has ``word``.

    ``records``: gbk_file, record_id, sequence; ``features``: gbk_file, record_id, ordinal, type, products, start, end.
    """
    return build_index(region_orfs(indexed_regions(features, word), records, **limits))


def predict_selection(selection: DataFrame, candidates: DataFrame, rules: dict[str, Rule] | None = None, top_n: int = 3) -> DataFrame:
    """Predicted cores of selected candidates, both orientations; a candidate without a site keeps one row."""
    chosen = candidates.join(selection.select("candidate_id").distinct(), "candidate_id")
    clean = chosen.select("candidate_id", F.upper(F.regexp_replace("protein", "[^A-Za-z]", "")).alias("sequence"))
    found = predict(clean, "candidate_id", rules, top_n, allow_inverted=True).drop("sequence")
    return chosen.join(found.withColumnRenamed("rank", "core_rank"), "candidate_id", "left")
