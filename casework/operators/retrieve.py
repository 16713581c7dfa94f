"""Chunks, vectors, exact nearest neighbours and prompt assembly."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casework.functions.numbers import round_even
from casework.functions.text import collapse_spaces
from casework.session import compute_once

CHUNK_WORDS, CHUNK_OVERLAP = 300, 50
CHUNK_METADATA = ("case_type", "sub_type", "verdict", "court", "year")
# Queries up to this many rows travel to every task; more of them are matched tile by tile.
BROADCAST_QUERIES = 2_048
TILE_ROWS = 4_096
# Rows of a side that travel to a task together, and rows of a side that are scored at a time.
BLOCK_ROWS, SCORED_ROWS = 8_192, 1_024


def chunk(
    df: DataFrame,
    case_id: str = "case_id",
    text: str = "case_text",
    size: int = CHUNK_WORDS,
    overlap: int = CHUNK_OVERLAP,
    metadata: tuple[str, ...] = CHUNK_METADATA,
) -> DataFrame:
    """Overlapping word windows; the last one ends with the text. Blank texts give none."""
    step = max(1, size - overlap)
    key = F.coalesce(F.col(case_id).cast("string"), F.lit("unknown"))
    present = [c for c in metadata if c in df.columns]
    labels = (
        F.map_from_arrays(
            F.array(*[F.lit(c) for c in present]), F.array(*[F.col(c).cast("string") for c in present])
        )
        if present
        else F.create_map().cast("map<string,string>")
    )
    words = F.split(collapse_spaces(F.col(text)), " ")
    df = compute_once(df.select(key.alias("case_id"), text, labels.alias("metadata")), {"_w": words}).drop(text)
    df = df.filter((F.size("_w") > 0) & (F.element_at("_w", 1) != ""))
    count = F.size("_w")
    chunks = F.when(count <= size, 1).otherwise(F.ceil((count - size) / F.lit(step)) + 1).cast("int")
    df = df.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), chunks - 1)))
    start = F.col("chunk_index") * step
    return df.select(
        F.format_string("%s_chunk_%04d", "case_id", "chunk_index").alias("chunk_id"),
        "case_id",
        "chunk_index",
        F.array_join(F.slice("_w", start + 1, F.lit(size)), " ").alias("text"),
        start.alias("word_start"),
        F.least(start + size, F.size("_w")).alias("word_end"),
        "metadata",
    )


def embed(chunks: DataFrame, text: str = "text", dim: int = 256, encoder=None) -> DataFrame:
    """Add ``embedding``, unit norm. *encoder* is a pandas UDF text -> array<float>; without one,
    hashed word counts serve."""
    if encoder is not None:
        return chunks.withColumn("embedding", encoder(F.col(text)))
    df = chunks.withColumn("_words", F.split(F.lower(collapse_spaces(F.col(text))), " "))
    df = HashingTF(numFeatures=dim, inputCol="_words", outputCol="_tf").transform(df)
    df = Normalizer(inputCol="_tf", outputCol="_unit").transform(df)
    vector = vector_to_array("_unit", "float32")
    return df.withColumn("embedding", vector).drop("_words", "_tf", "_unit")


def _best_hits(metric: str, k: int):
    """Kernel of the scan: best k rows per query of one batch of vectors."""

    def best(query_ids, query_vecs, query_tags, ids, vecs, tags, query_skips, skips):
        import numpy as np

        scores = vecs @ query_vecs.T
        if metric == "l2":
            scores = 2 * scores - (vecs * vecs).sum(1)[:, None] - (query_vecs * query_vecs).sum(1)[None, :]
        scores = np.round(scores, 10)
        if tags is not None:
            scores[tags[:, None] != query_tags[None, :]] = -np.inf
        if skips is not None:
            scores[skips[:, None] == query_skips[None, :]] = -np.inf
        out = []
        for q in range(scores.shape[1]):
            column = scores[:, q]
            rows = np.arange(len(column))
            if len(column) > k:
                # everything at or above the k-th score, so that ties are settled by id
                rows = np.flatnonzero(column >= np.partition(column, len(column) - k)[len(column) - k])
            rows = rows[np.isfinite(column[rows])]
            rows = rows[np.lexsort((ids[rows], -column[rows]))][:k]
            out.extend((query_ids[q], ids[r], float(column[r])) for r in rows)
        return out

    return best


def _best_of_block(metric: str, k: int, scored_rows: int):
    """Kernel of two blocks of rows: the best k of *v* for every row of *q*, equal scores by id.

    Holds the scores of *scored_rows* by *scored_rows* pairs and the best k so far. Scores that are
    no finite numbers never rank.
    """

    def merged(top, at, scores, start):
        """Scores and places of the best k, after those of the columns from *start* on; both are in rank order."""
        import numpy as np

        rows = np.flatnonzero(scores.max(1) > top[:, -1])
        if not len(rows):
            return
        every = np.concatenate((top[rows], scores[rows]), 1)
        least = np.partition(every, every.shape[1] - k, axis=1)[:, every.shape[1] - k]
        # everything at or above the k-th score: places rise along the columns and settle ties
        r, c = np.nonzero(every >= least[:, None])
        order = np.lexsort((c, -every[r, c], r))
        r, c = r[order], c[order]
        first = np.searchsorted(r, np.arange(len(rows)))
        keep = np.arange(len(r)) - first[r] < k
        c = c[keep].reshape(len(rows), k)
        places = np.concatenate((at[rows], np.broadcast_to(start + np.arange(scores.shape[1]), scores[rows].shape)), 1)
        top[rows], at[rows] = np.take_along_axis(every, c, 1), np.take_along_axis(places, c, 1)

    def best(q, v, skip):
        import numpy as np
        import pandas as pd

        v = v.sort_values("id", kind="stable", na_position="first")
        q_vecs, v_vecs = (np.asarray(x["embedding"].tolist(), dtype="float64").reshape(len(x), -1) for x in (q, v))
        if skip:
            own, other = (x[skip].to_numpy(dtype=object) for x in (q, v))
            codes = pd.factorize(np.concatenate((own, other)))[0]
            own, other = codes[: len(q)], codes[len(q) :]
            if q[skip].dtype != object:  # a missing number equals nothing, a missing string another one
                own = np.where(own < 0, -2, own)
        q_ids, v_ids = q["id"].to_numpy(), v["id"].to_numpy()
        parts = []
        for low in range(0, len(q), scored_rows):
            x = q_vecs[low : low + scored_rows]
            top, at = np.full((len(x), k), -np.inf), np.zeros((len(x), k), dtype=np.int64)
            for start in range(0, len(v), scored_rows):
                y = v_vecs[start : start + scored_rows]
                scores = x @ y.T
                if metric == "l2":
                    scores = 2 * scores - (x * x).sum(1)[:, None] - (y * y).sum(1)[None, :]
                np.round(scores, 10, out=scores)
                scores[~np.isfinite(scores)] = -np.inf
                if skip:
                    scores[own[low : low + scored_rows, None] == other[None, start : start + scored_rows]] = -np.inf
                merged(top, at, scores, start)
            row, rank = np.nonzero(np.isfinite(top))
            parts.append(pd.DataFrame({"query_id": q_ids[low + row], "id": v_ids[at[row, rank]], "score": top[row, rank]}))
        return pd.concat(parts, ignore_index=True)

    return best


def top_k(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    metric: str = "ip",
    same: str | None = None,
    skip: str | None = None,
    broadcast_queries: int | None = None,
    tile_rows: int | None = None,
) -> DataFrame:
    """Exact k best vectors of every query: (query_id, id, score, rank).

    Both tables hold ``id`` and ``embedding``. *same* names a column that must be
    equal on both sides, *skip* one that must differ. Scores are rounded to ten
    digits before ranking, equal scores go by id.

    The number of queries is counted first. A bounded set travels to the tasks
    and the vectors are scanned where they lie, each task answering with its k
    best per query. A larger set is cut into blocks of tiles, and so are the vectors;
    each pair of blocks meets in one task of fixed memory, blocks of different *same*
    values never. Neither shape ever holds more than a tile of pairs, and no
    pair is emitted unless it is among a block's best k. *broadcast_queries* and
    *tile_rows* set these sizes; both shapes give the same rows.
    """
    id_type = vectors.schema["id"].dataType.simpleString()
    query_type = queries.schema["id"].dataType.simpleString()
    extra = [c for c in (same, skip) if c and c != "id"]
    q = queries.filter("embedding IS NOT NULL").select("id", "embedding", *dict.fromkeys(extra))
    v = vectors.filter("embedding IS NOT NULL").select("id", "embedding", *dict.fromkeys(extra))
    schema = f"query_id {query_type}, id {id_type}, score double"
    broadcast_queries = BROADCAST_QUERIES if broadcast_queries is None else broadcast_queries
    known = q.limit(broadcast_queries + 1).collect()  # bounded: this many rows at most
    if len(known) <= broadcast_queries:
        hits = _scan_top_k(known, v, k, metric, same, skip, schema)
    else:
        hits = _tiled_top_k(q, v, k, metric, same, skip, schema, tile_rows)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _scan_top_k(known, vectors, k, metric, same, skip, schema) -> DataFrame:
    spark = vectors.sparkSession
    if not known:
        return spark.createDataFrame([], schema)
    columns = {
        "id": [r["id"] for r in known],
        "vec": [list(r["embedding"]) for r in known],
        "same": [r[same] for r in known] if same else None,
        "skip": [r[skip] for r in known] if skip else None,
    }
    sent = spark.sparkContext.broadcast(columns)
    best = _best_hits(metric, k)

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        qs = sent.value
        vecs = np.asarray(qs["vec"], dtype="float64")
        tags = np.asarray(qs["same"], dtype=object) if same else None
        skips = np.asarray(qs["skip"], dtype=object) if skip else None
        kept: dict = {}
        for batch in batches:
            for start in range(0, len(batch), 4096):
                part = batch.iloc[start : start + 4096]
                for query, row, score in best(
                    qs["id"],
                    vecs,
                    tags,
                    part["id"].to_numpy(),
                    np.asarray(part["embedding"].tolist(), dtype="float64"),
                    part[same].to_numpy(dtype=object) if same else None,
                    skips,
                    part[skip].to_numpy(dtype=object) if skip else None,
                ):
                    kept.setdefault(query, []).append((-score, row))
            for query, hits in kept.items():
                kept[query] = sorted(hits)[:k]
        rows = [(query, row, -minus) for query, hits in kept.items() for minus, row in hits]
        if rows:
            yield pd.DataFrame(rows, columns=["query_id", "id", "score"])

    return vectors.mapInPandas(scan, schema)


def _tiled_top_k(queries, vectors, k, metric, same, skip, schema, tile_rows) -> DataFrame:
    # missing values form a group of their own, as in the scan
    group = F.coalesce(F.concat(F.lit("="), F.col(same).cast("string")), F.lit("")) if same else F.lit("")
    return match_tiles(
        queries.withColumn("_group", group), vectors.withColumn("_group", group), "_group", k, metric, skip, schema, tile_rows
    )


def match_tiles(queries, vectors, group, k, metric, skip, schema, tile_rows=None) -> DataFrame:
    """(query_id, id, score): the best k per query and block, of vectors of the query's own *group*.

    Each group is cut into as many blocks of tiles as its rows need, so a group with a third of all rows is
    spread as well; each row is copied once per block of the other side, however small the tiles are, and a
    pair of blocks meets in one task that scores a pair of tiles at a time. A null group matches nothing.
    """
    tile_rows = tile_rows or TILE_ROWS
    block_rows = max(tile_rows, BLOCK_ROWS)
    best = _best_of_block(metric, k, min(tile_rows, SCORED_ROWS))

    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(group).agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias(name))

    tiles = sizes(queries, "_q_tiles").join(sizes(vectors, "_v_tiles"), group)  # one row per group

    def place(df: DataFrame, own: str, other: str) -> DataFrame:
        df = df.join(tiles, group)
        tile = F.pmod(F.xxhash64("id"), F.col(f"_{own}_tiles")).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.col(f"_{other}_tiles") - 1))
        df = df.withColumn(f"_{own}", tile).withColumn(f"_{other}", others).drop("_q_tiles", "_v_tiles")
        return df.select(*[F.col(c).alias(c) for c in df.columns])  # the two sides may be one table

    def meet(q, v):
        import pandas as pd

        if q.empty or v.empty:
            return pd.DataFrame(columns=["query_id", "id", "score"])
        return best(q, v, skip)

    keys = (group, "_q", "_v")
    left, right = place(queries, "q", "v"), place(vectors, "v", "q")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, schema)


def search(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """``top_k`` with what a reader wants to see: score to 4 digits, 300 characters, metadata."""
    hits = top_k(queries, vectors, k)
    seen = [c for c in ("text", "metadata") if c in vectors.columns]
    if seen:
        hits = hits.join(vectors.select("id", *seen), "id")
    if "text" in seen:
        hits = hits.withColumn("text", F.substring("text", 1, 300))
    return hits.withColumn("score", round_even(F.col("score"), 4))


def similar_cases(cases: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """The k chunks nearest to each query case among the chunks of other cases.

    *cases* holds id and embedding (of the first 500 characters). Own chunks are
    left out before the cut, so k results remain.
    """
    if not 1 <= k <= 20:
        raise ValueError("k lies between 1 and 20")
    queries = cases.withColumn("case_key", F.col("id").cast("string"))
    owners = vectors.withColumn("case_key", F.substring_index(F.col("id").cast("string"), "_chunk_", 1))
    hits = top_k(queries, owners, k, skip="case_key")
    return hits.withColumn("score", round_even(F.col("score"), 4))


def context_line(rank: Column, hit_id: Column, score: Column, metadata: Column, text: Column) -> Column:
    # format_number rounds the binary value, as the usual %.3f does; format_string rounds its decimal text
    head = F.format_string("[Case %d] ID=%s  Score=%s", rank, hit_id.cast("string"), F.format_number(score, 3))
    kind = F.try_element_at(metadata, F.lit("case_type"))
    verdict = F.coalesce(F.try_element_at(metadata, F.lit("verdict")), F.lit("?"))
    labels = F.when(
        F.coalesce(kind, F.lit("")) != "", F.concat(F.lit("  Type="), kind, F.lit("  Verdict="), verdict)
    ).otherwise("")
    return F.concat(head, labels, F.lit("\n"), text)


def format_context(hits: DataFrame) -> DataFrame:
    """(query_id, context, sources): the hits of a query, at most k, in rank order."""
    line = context_line(F.col("rank"), F.col("id"), F.col("score"), F.col("metadata"), F.col("text"))
    entry = F.struct("rank", line.alias("line"), F.col("id").alias("id"))
    grouped = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return grouped.select(
        "query_id",
        F.array_join(F.transform("e", lambda x: x["line"]), "\n\n").alias("context"),
        F.transform("e", lambda x: x["id"]).alias("sources"),
    )


# The four prompt templates.
TEMPLATES = {
    "legal_qa": (
        "You are an expert legal analyst. Use the following retrieved case excerpts to answer the question.\n\n"
        "RETRIEVED CASES:\n{context}\n\nQUESTION: {question}\n\n"
        "Provide a concise, accurate legal answer citing the relevant cases where applicable.\nANSWER:"
    ),
    "case_summary": (
        "Summarise the following legal case in 3-5 sentences, noting the case type, verdict, and key legal "
        "principles.\n\nCASE TEXT:\n{case_text}\n\nSUMMARY:"
    ),
    "verdict_explanation": (
        "Given the following case facts and verdict, explain the legal reasoning.\n\n"
        "CASE FACTS:\n{facts}\n\nVERDICT: {verdict}\n\nLEGAL REASONING:"
    ),
    "similar_cases": (
        "Based on the retrieved similar cases below, identify common legal patterns.\n\n"
        "QUERY CASE: {query}\n\nSIMILAR CASES:\n{context}\n\nPATTERNS:"
    ),
}


def fill_template(name: str, **values: Column) -> Column:
    """A template with its slots filled. The pieces between slots are literals, so a value that
    happens to hold a slot name is left as it is."""
    pieces, rest = [], TEMPLATES[name]
    while rest:
        before, brace, after = rest.partition("{")
        pieces.append(F.lit(before))
        if not brace:
            break
        slot, _, rest = after.partition("}")
        if slot not in values:
            raise ValueError(f"template {name} needs a column {slot}")
        pieces.append(F.coalesce(values[slot], F.lit("")))
    return F.concat(*pieces)


def build_prompts(questions: DataFrame, contexts: DataFrame | None = None, template: str = "legal_qa") -> DataFrame:
    """(id, question, prompt, sources) for questions (id, question ...) and their contexts.

    The slots are filled from the context, the question and the other columns of *questions* by their names
    (case_text, or facts and verdict); templates without a context need no *contexts*.
    """
    columns = {c: F.col(c) for c in questions.columns}
    if contexts is not None:
        renamed = contexts.select(F.col("query_id").alias("_query"), F.col("context").alias("_context"), F.col("sources").alias("_sources"))
        questions = questions.join(renamed, questions["id"] == F.col("_query"), "left")
        columns["context"] = F.col("_context")
    else:
        questions = questions.withColumn("_sources", F.lit(None).cast("string"))
    if "question" in columns:
        columns.setdefault("query", F.col("question"))
    asked = F.col("question") if "question" in columns else F.lit(None).cast("string").alias("question")
    return questions.select("id", asked, fill_template(template, **columns).alias("prompt"), F.col("_sources").alias("sources"))


def _word_set(c: Column) -> Column:
    words = F.split(collapse_spaces(F.lower(F.coalesce(c, F.lit("")))), " ")
    return F.filter(F.array_distinct(words), lambda w: w != "")


def rag_scores(df: DataFrame, question: str = "question", docs: str = "docs", answer: str = "answer") -> DataFrame:
    """Add context_precision and answer_relevance: shares of words found in the retrieved texts."""
    df = df.withColumn("_d", _word_set(F.array_join(docs, " ")))

    def share(c: str) -> Column:
        words = _word_set(F.col(c))
        found = F.size(F.array_intersect(words, F.col("_d"))) / (F.size(words) + 1e-9)
        return F.least(round_even(found, 3), F.lit(1.0))

    return df.withColumns({"context_precision": share(question), "answer_relevance": share(answer)}).drop("_d")


def rag_eval(scored: DataFrame) -> DataFrame:
    return scored.agg(
        round_even(F.avg("context_precision"), 3).alias("avg_context_precision"),
        round_even(F.avg("answer_relevance"), 3).alias("avg_answer_relevance"),
        F.count("*").alias("n_queries"),
    )
