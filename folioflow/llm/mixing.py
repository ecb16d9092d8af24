"""Problem 8: a collection mixed from sources to target token shares, by hierarchical budgeting.

Targets are propagated down a tree domain > language > source.  A source that cannot fill its budget even when repeated
``max_repeats`` times passes its shortage to its siblings of the same language, then to the other languages of its
domain, then to the other domains, always in proportion to target weight.  Each source is then filled by whole epochs
and a token prefix of one more epoch, whose order is a seeded hash of the document.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window as W, functions as F

from folioflow.llm.bpe_fst import TOKENIZER_DIR
from folioflow.llm.tokens import with_token_counts
from folioflow.session import cut

#: Prefix sums run over this many hash ranges of a source first; rows are only ordered within one range.
RANGES = 1 << 16

#: Most sources that a target table may have: the budget tree of these is solved on the driver.
MAX_TARGETS = 10_000


@dataclass
class Node:
    """A node of the budget tree; leaves have ``weight`` and ``room`` (tokens available times repeats)."""

    name: str
    weight: float = 0.0
    room: float = 0.0
    children: list["Node"] = field(default_factory=list)
    budget: float = 0.0

    def settle(self) -> None:
        for child in self.children:
            child.settle()
        if self.children:
            self.weight = sum(c.weight for c in self.children)
            self.room = sum(c.room for c in self.children)


def _fill(node: Node, budget: float) -> None:
    """Give ``budget`` to ``node``: each child by weight, full ones leave their rest to their siblings."""
    node.budget = min(budget, node.room)
    open_, rest = [c for c in node.children if c.weight > 0], node.budget
    wanted = {id(c): 0.0 for c in node.children}
    while open_ and rest > 1e-9:
        weight = sum(c.weight for c in open_)
        full = [c for c in open_ if rest * c.weight / weight >= c.room - wanted[id(c)]]
        if not full:
            for c in open_:
                wanted[id(c)] += rest * c.weight / weight
            break
        for c in full:
            rest -= c.room - wanted[id(c)]
            wanted[id(c)] = c.room
        open_ = [c for c in open_ if c not in full]
    for c in node.children:
        _fill(c, wanted[id(c)])


def solve_budgets(leaves: list[dict], total: float) -> dict[str, float]:
    """Token budget of each source. ``leaves``: source, domain, language, weight, room. Weights need not add up to 1."""
    domains: dict[str, dict[str, list[Node]]] = {}
    nodes = {}
    for leaf in sorted(leaves, key=lambda x: str(x["source"])):
        node = nodes[leaf["source"]] = Node(leaf["source"], max(float(leaf["weight"] or 0), 0.0), float(leaf["room"]))
        domains.setdefault(str(leaf["domain"]), {}).setdefault(str(leaf["language"]), []).append(node)
    root = Node("", children=[Node(d, children=[Node(lang, children=ns) for lang, ns in langs.items()]) for d, langs in domains.items()])
    root.settle()
    _fill(root, total)
    return {name: node.budget for name, node in nodes.items()}


def _targets(mix_targets: DataFrame) -> DataFrame:
    return (
        mix_targets.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.greatest(F.min(F.coalesce("max_repeats", F.lit(1))), F.lit(0)).alias("max_repeats"))
    )


def mix_sources(
    documents: DataFrame,
    mix_targets: DataFrame,
    total_tokens: int | None = None,
    seed: int = 7,
    tokenizer: str = "byte_bpe_50k",
    folder: str = TOKENIZER_DIR,
) -> tuple[DataFrame, DataFrame]:
    """The mixed collection and the shares reached.

    Collection: ``source, doc_id, copy_no`` (1 to ``max_repeats``), ``n_tokens``: one row for each time a document occurs.
    Shares: one row a target with ``target_share, max_repeats, domain, language, documents, available_tokens,
    budget_tokens, tokens, reached_share, max_copies, short_tokens`` (what it lacks to its own target).

    ``total_tokens`` is the size aimed at; by default the tokens of all documents of the listed sources, once each.  A
    source takes its place in the tree by the ``subject_category`` and ``lang`` that hold most of its tokens (missing
    labels count as a label).  Documents without a token (null or empty text) and sources not listed take no part.  A
    target of a source without documents gets nothing and its share goes to siblings first.  A null or negative share
    counts as 0, null repeats as 1; several targets of a source are added up.  The result depends on ids, texts
    and ``seed`` only, not on partitioning.

    The prefix of a source is found from sums of hash ranges; only the one range in which the budget runs out is ordered
    by row, so no task holds a whole source.
    """
    targets = _targets(mix_targets)
    keep = {c: F.col(c) for c in ("doc_id", "source", "lang", "subject_category")}
    listed = documents.select("doc_id", "source", "lang", "subject_category", "text").join(targets.select("source"), "source", "left_semi")
    tokens = cut(with_token_counts(listed, keep, F.col("text"), tokenizer, folder).where("n_tokens > 0"))

    labels = tokens.groupBy("source", F.coalesce("subject_category", F.lit("")).alias("domain"), F.coalesce("lang", F.lit("")).alias("language")).agg(
        F.sum("n_tokens").alias("t"), F.count("*").alias("n")
    )
    place = labels.groupBy("source").agg(
        F.max_by(F.struct("domain", "language"), F.struct("t", "domain", "language")).alias("p"), F.sum("t").alias("available"), F.sum("n").alias("documents")
    )
    stats = targets.join(place, "source", "left").select(
        "source", "target_share", "max_repeats", "p.domain", "p.language", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("available", F.lit(0)).alias("available")
    )
    rows = stats.limit(MAX_TARGETS + 1).collect()  # one row a target
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    total = float(sum(r.available for r in rows) if total_tokens is None else total_tokens)
    leaves = [dict(source=r.source, domain=r.domain, language=r.language, weight=r.target_share, room=r.available * r.max_repeats) for r in rows]
    budgets = solve_budgets(leaves, total)
    spark = documents.sparkSession
    plan = spark.createDataFrame(
        [
            (r.source, float(r.target_share or 0), r.max_repeats, r.domain, r.language, r.documents, r.available, budgets[r.source],
             int(min(r.max_repeats, (budgets[r.source] + 1e-6) // r.available)) if r.available else 0)
            for r in rows
        ],
        "source string, target_share double, max_repeats int, domain string, language string, documents long, available_tokens long, budget_tokens double, epochs int",
    )
    plan = plan.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget_tokens") - F.col("epochs") * F.col("available_tokens")).otherwise(F.lit(0.0)))

    # the order of the partial epoch, by a hash of seed, epoch and document
    ranked = tokens.join(plan.select("source", "epochs", "rest"), "source").withColumn("h", F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id")))
    ranked = ranked.withColumn("range", F.shiftrightunsigned("h", 64 - RANGES.bit_length() + 1))
    sums = ranked.where("rest > 0").groupBy("source", "range", "rest").agg(F.sum("n_tokens").alias("s"))
    sums = sums.withColumn("before", F.sum("s").over(W.partitionBy("source").orderBy("range")) - F.col("s"))
    edge = sums.where("before < rest and before + s >= rest").select("source", F.col("range").alias("edge"), "before")
    ranked = ranked.join(edge, "source", "left")
    inside = ranked.where("rest > 0 and (edge is null or range < edge)").select("source", "doc_id", "epochs", "n_tokens")
    order = W.partitionBy("source").orderBy("h", "doc_id")
    at_edge = ranked.where("rest > 0 and range = edge").withColumn("upto", F.col("before") + F.sum("n_tokens").over(order))
    at_edge = at_edge.where("upto - n_tokens / 2 <= rest").select("source", "doc_id", "epochs", "n_tokens")
    partial = inside.unionByName(at_edge).select("source", "doc_id", (F.col("epochs") + 1).alias("copy_no"), "n_tokens")
    full = ranked.where("epochs > 0").select("source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("epochs"))).alias("copy_no"), "n_tokens")
    mixed = cut(full.unionByName(partial))  # read for the shares and for the rows

    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("copy_no").alias("max_copies"))
    shares = plan.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    whole = shares.agg(F.sum("tokens").alias("_all"))
    shares = shares.join(F.broadcast(whole), F.lit(True)).select(  # the one row of a global sum
        "source", "target_share", "max_repeats", "domain", "language", "documents", "available_tokens",
        F.round("budget_tokens", 3).alias("budget_tokens"), "tokens",
        F.when(F.col("_all") > 0, F.col("tokens") / F.col("_all")).otherwise(F.lit(0.0)).alias("reached_share"),
        F.coalesce("max_copies", F.lit(0)).alias("max_copies"),
        F.greatest(F.round(F.col("target_share") * F.lit(total) - F.col("tokens"), 3), F.lit(0.0)).alias("short_tokens"),
    )
    return mixed, shares


def mixed_with_shares(documents: DataFrame, mix_targets: DataFrame, **options) -> DataFrame:
    """The collection with each source's ``target_share`` and ``reached_share`` beside every row."""
    mixed, shares = mix_sources(documents, mix_targets, **options)
    return mixed.join(shares.select("source", "target_share", "reached_share"), "source")
