"""Concept-graph features of documents, in long form."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import id_chunks, numbered


def oriented(edges: DataFrame, concept: Column, lang: str = "en", min_weight: float = 1.0) -> DataFrame:
    """Edges of a queried ``concept`` turned away from it: ``concept, other, rel, weight``.

    Both ends must be in ``lang`` (columns ``start_lang``, ``end_lang``) and the weight
    ``min_weight`` or more; an edge that doesn't touch the concept goes."""
    e = edges.withColumn("concept", concept).filter((F.col("start_lang") == lang) & (F.col("end_lang") == lang) & (F.col("weight") >= min_weight))
    other = F.when(F.col("start") == F.col("concept"), F.col("end")).when(F.col("end") == F.col("concept"), F.col("start"))
    return e.select("concept", other.alias("other"), "rel", "weight").filter("other IS NOT NULL")


def edge_max(edges: DataFrame, min_weight: float = 0.0) -> DataFrame:
    return edges.filter(F.col("weight") >= min_weight).groupBy("start", "end", "rel").agg(F.max("weight").alias("weight"))


def concept_tokens(tokens: DataFrame, lexicon: DataFrame, tags: list[str], stop_words: list[str]) -> DataFrame:
    """First position of each token whose tag is wanted and that isn't a stop word."""
    kept = tokens.join(lexicon, "tok").filter(F.col("tag").isin(tags) & ~F.col("tok").isin(stop_words))
    return kept.groupBy("doc_id", "tok").agg(F.min("pos").alias("pos"))


def sequential_edges(tokens: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("pos")
    fwd = tokens.select("doc_id", F.col("pos").alias("src"), F.lead("pos").over(w).alias("dst")).filter("dst IS NOT NULL")
    return fwd.select("doc_id", F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("doc_id", "e.src", "e.dst")


def concept_pairs(firsts: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges from an earlier concept of a document to a later one.

    Tokens meet edges first, so pairs without an edge are never made."""
    a = firsts.select("doc_id", F.col("tok").alias("start"), F.col("pos").alias("i"))
    b = firsts.select("doc_id", F.col("tok").alias("end"), F.col("pos").alias("j"))
    return a.join(edges, "start").join(b, ["doc_id", "end"]).filter("i < j").select("doc_id", "start", "end", "rel", "weight", "i", "j")


def prefix_pairs(words: DataFrame) -> DataFrame:
    """``doc_id, concept, tok`` where a concept and a token of a document are equal or one
    begins the other; ``words`` has ``doc_id, word, concept, token`` (is it one?), once each.

    Words are sorted within a document; what begins a word stands just before it, so a
    stack of words that begin the next one is all that is kept, and no prefix is made.
    Tasks hold the words of a document with one first letter, at most."""

    def sweep(batches):
        doc, stack = None, []
        for batch in batches:
            found: list[tuple[int, str, str]] = []
            ids = batch.column(0).to_pylist()
            for n, (word, is_concept, is_token) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:4]))):
                if n == 0 and doc != (ids[0],) or n and ids[n] != ids[n - 1]:
                    doc, stack = (ids[n],), []
                while stack and not word.startswith(stack[-1][0]):
                    stack.pop()
                stack.append((word, is_concept, is_token))
                for other, other_concept, other_token in stack:
                    if other_concept and is_token:
                        found.append((n, other, word))
                    if other_token and is_concept and other is not word:
                        found.append((n, word, other))
            at = pa.array([n for n, _, _ in found], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([c for _, c, _ in found], pa.string()), pa.array([t for _, _, t in found], pa.string())], ["doc_id", "concept", "tok"])

    kind = words.schema["doc_id"].dataType.simpleString()
    parts = words.select("doc_id", "word", "concept", "token").repartition("doc_id", F.substring("word", 1, 1)).sortWithinPartitions("doc_id", "word")
    return parts.mapInArrow(sweep, f"doc_id {kind}, concept string, tok string")


def concept_align(concepts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Token positions that equal a concept or of which one is the other's prefix."""
    word = lambda df, concept: df.filter("tok <> ''").select("doc_id", F.col("tok").alias("word"), F.lit(concept).alias("concept"), F.lit(not concept).alias("token"))
    words = word(concepts, True).union(word(tokens, False)).groupBy("doc_id", "word").agg(F.max("concept").alias("concept"), F.max("token").alias("token"))
    pairs = prefix_pairs(words)
    places = tokens.select(F.col("doc_id").alias("of_doc"), F.col("tok").alias("of_tok"), "pos")  # join last
    return pairs.join(places, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("tok") == F.col("of_tok"))).select("doc_id", "concept", "pos")


def relation_vocab(edges: DataFrame) -> DataFrame:
    """0 is the sequential relation; the others are numbered in order of name."""
    rels = edges.select("rel").distinct()
    return rels.select("rel", F.row_number().over(Window.orderBy("rel")).alias("rel_id")).union(edges.sparkSession.sql("SELECT 'sequential', 0"))


def irf_weights(edges: DataFrame) -> DataFrame:
    """Inverse relation frequency, relation 0 as high as the highest, summing to 1."""
    c = edges.groupBy("rel").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    raw = c.crossJoin(total).select("rel", F.log(F.col("total") / F.col("n") + 1).alias("w"))
    both = raw.union(raw.agg(F.lit("sequential").alias("rel"), F.max("w").alias("w")))
    return both.crossJoin(both.agg(F.sum("w").alias("s"))).select("rel", (F.col("w") / F.col("s")).alias("weight"))


def doc_graph(tokens: DataFrame, firsts: DataFrame, edges: DataFrame, vocab: DataFrame) -> DataFrame:
    """Sequential edges and semantic ones in both directions, normalised a document;
    a document without edges gets a loop at its first position."""
    seq = sequential_edges(tokens).select("doc_id", "src", "dst", F.lit(0).alias("rel_id"), F.lit(1.0).alias("weight"))
    p = concept_pairs(firsts, edges).join(vocab, "rel")
    both = F.array(F.struct(F.col("i").alias("src"), F.col("j").alias("dst")), F.struct(F.col("j").alias("src"), F.col("i").alias("dst")))
    sem = p.select("doc_id", F.explode(both).alias("e"), "rel_id", "weight").select("doc_id", "e.src", "e.dst", "rel_id", "weight")
    some = seq.union(sem)
    loops = tokens.groupBy("doc_id").agg(F.min("pos").alias("src")).join(some.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "src", F.col("src").alias("dst"), F.lit(0).alias("rel_id"), F.lit(1.0).alias("weight"))
    total = F.sum("weight").over(Window.partitionBy("doc_id"))
    return some.union(loops).withColumn("weight", F.when(total > 0, F.col("weight") / total).otherwise(F.col("weight")))


def neighbours(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    return concepts.select(F.col("tok").alias("start")).distinct().join(edges, "start")


def graph_offset(graph: DataFrame, batch: int, max_len: int | None = None) -> DataFrame:
    """Node ids moved apart for the documents of a batch of ``batch`` documents, by
    ``max_len``, or as far as the longest document needs.  Ids are numbers."""
    if max_len is None:
        max_len = (graph.agg(F.max(F.greatest("src", "dst"))).first()[0] or 0) + 1
    moved = batched(graph, batch, max_len)
    return moved.select("doc_id", "batch", (F.col("src") + F.col("off")).alias("src"), (F.col("dst") + F.col("off")).alias("dst"), "rel_id")


def batched(rows: DataFrame, batch: int, max_len: int) -> DataFrame:
    """``rows`` with ``batch``, of ``batch`` documents each, and ``off``, ``max_len`` for each
    document before it there."""
    docs = rows.select("doc_id").distinct()
    k = F.col("rn") - 1
    docs = numbered(docs, [], [F.col("doc_id")], id_chunks(docs, "doc_id")).select("doc_id", F.floor(k / batch).alias("batch"), ((k % batch) * max_len).alias("off"))
    return rows.join(docs.hint("shuffle_hash"), "doc_id")


def edge_class(tokens: DataFrame, firsts: DataFrame, edges: DataFrame) -> DataFrame:
    """Each undirected pair of positions: sequential, semantic or both."""
    order = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    seq = sequential_edges(tokens).select("doc_id", *order("src", "dst")).distinct().withColumn("s", F.lit(True))
    a, b = firsts.select("doc_id", F.col("tok").alias("start"), F.col("pos").alias("i")), firsts.select("doc_id", F.col("tok").alias("end"), F.col("pos").alias("j"))
    sem = a.join(edges, "start").join(b, ["doc_id", "end"]).filter("i <> j").groupBy("doc_id", *order("i", "j")).agg(F.array_join(F.array_sort(F.collect_set("rel")), ",").alias("rels"), F.max("weight").alias("max_weight"))
    both = seq.join(sem, ["doc_id", "a", "b"], "full_outer")
    kind = F.when(F.col("s") & F.col("rels").isNotNull(), "both").when(F.col("s"), "sequential").otherwise("semantic")
    return both.select("doc_id", "a", "b", kind.alias("kind"), "rels", "max_weight")


def relation_neighbour_mean(vectors: DataFrame, edges: DataFrame, n_relations: int | None = None) -> DataFrame:
    """Per node and dimension: the sum over relations of the mean neighbour, added to
    the node itself, not below 0.  A relation out of 0 to ``n_relations - 1`` counts as 0."""
    if n_relations is not None:
        edges = edges.withColumn("rel_id", F.when(F.col("rel_id").between(0, n_relations - 1), F.col("rel_id")).otherwise(0))
    long = vectors.select("node", F.posexplode("vec").alias("dim", "x"))
    mean = edges.join(long.withColumnRenamed("node", "src"), "src").groupBy("dst", "rel_id", "dim").agg(F.avg("x").alias("m"))
    total = mean.groupBy(F.col("dst").alias("node"), "dim").agg(F.sum("m").alias("m"))
    return long.join(total, ["node", "dim"], "left").select("node", "dim", F.greatest(F.lit(0.0), F.col("x") + F.coalesce("m", F.lit(0.0))).alias("x"))


def edge_scale(edges: DataFrame, weights: DataFrame, embedding: DataFrame) -> DataFrame:
    """Relation embedding x inverse frequency x edge weight, per dimension."""
    scaled = edges.join(weights.withColumnRenamed("weight", "irf"), "rel").join(embedding, "rel")
    return scaled.select("start", "end", "rel", F.posexplode(F.transform("vec", lambda x: x * F.col("irf") * F.col("weight"))).alias("dim", "x"))


def score_batches(nodes: DataFrame, edges: DataFrame, loader: Callable, batch: int, max_len: int, n_relations: int, vec: str = "vec") -> DataFrame:
    """``doc_id, prob1, predicted_label, confidence`` of a graph model, batch by batch.

    ``nodes``: ``doc_id, pos`` and a vector; ``edges``: ``doc_id, src, dst, rel_id, weight``
    (``doc_graph``).  ``batch`` documents make one graph: the ``k``-th has its nodes moved by
    ``k * max_len``; nodes and edges beyond ``max_len`` are left out, and a relation out of
    0 to ``n_relations - 1`` counts as 0.  ``loader()`` makes the model once a task; it gets
    the vectors (documents x ``max_len`` nodes, zeros where there is none), source and
    target nodes, relations and weights of the edges, and the number of documents, and
    returns a probability of 1 for each document.  Documents without nodes aren't scored."""
    docs = nodes.filter(F.col("pos") < max_len).select("doc_id").distinct()
    docs = numbered(docs, [], [F.col("doc_id")], id_chunks(docs, "doc_id")).select("doc_id", F.floor((F.col("rn") - 1) / batch).alias("batch"), ((F.col("rn") - 1) % batch).alias("k"))
    kind = nodes.schema["doc_id"].dataType.simpleString()
    n = nodes.filter(F.col("pos").between(0, max_len - 1)).join(docs, "doc_id").select(F.col("batch").alias("node_batch"), "k", "doc_id", "pos", F.col(vec).cast("array<double>").alias("vec"))
    inside = F.col("src").between(0, max_len - 1) & F.col("dst").between(0, max_len - 1)
    rel = F.when(F.col("rel_id").between(0, n_relations - 1), F.col("rel_id")).otherwise(0)
    e = edges.filter(inside).join(docs, "doc_id").select(F.col("batch").alias("edge_batch"), (F.col("k") * max_len + F.col("src")).alias("src"), (F.col("k") * max_len + F.col("dst")).alias("dst"), rel.cast("int").alias("rel_id"), F.col("weight").cast("double").alias("weight"))

    def score(own: pa.Table, links: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table({"doc_id": own.column("doc_id"), "prob1": pa.array([], pa.float64())})
        k, pos = own.column("k").to_numpy(), own.column("pos").to_numpy()
        size = len(own.column("vec")[0])
        vectors = np.zeros((int(k.max()) + 1, max_len, size))
        vectors[k, pos] = own.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, size)
        first = np.unique(k, return_index=True)[1]  # a row of each document, in order
        prob = loader()(vectors, *(links.column(c).to_numpy() for c in ("src", "dst", "rel_id", "weight")), len(vectors))
        return pa.table({"doc_id": own.column("doc_id").combine_chunks().take(pa.array(first)), "prob1": pa.array(np.asarray(prob)[k[first]], pa.float64())})

    p = F.col("prob1")
    scored = n.groupBy("node_batch").cogroup(e.groupBy("edge_batch")).applyInArrow(score, f"doc_id {kind}, prob1 double")
    return scored.withColumns({"predicted_label": F.when(p >= 0.5, 1).otherwise(0), "confidence": F.greatest(p, 1 - p)})
