"""The registered queries of this subpackage, and the same questions in SQL where SQL can put them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm.bpe import LATIN_PATTERN, encode_texts
from casework.llm.jaccard import similar_documents
from casework.llm.licences import FILE_SHARE, LEAST_COSINE, TEMPLATES, scan_licences, terms
from casework.llm.mixture import mix_sources, token_count
from casework.llm.periods import periodic_runs
from casework.llm.quality import fit_quality, score_quality
from casework.llm.repeats import remove_repeats
from casework.llm.repetition import LINE_LIMIT, MIN_WORDS, NGRAM_LIMITS, repetition_rules
from casework.llm.secrets import scan_secrets
from casework.llm.substrings import LENGTH, remove_substrings
from casework.llm.topk import top_k
from casework.llm.variants import LEAST_COUNT, LEAST_LENGTH, TIMES, spelling_variants
from casework.llm.warc import LEAST, archive_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


@query
def op2_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents"))


def _repetition_sql() -> str:
    leads = ", ".join(f"lead(word, {k}) OVER doc AS w{k}" for k in range(1, max(NGRAM_LIMITS)))
    sizes = (3, *NGRAM_LIMITS)

    def gram(n: int) -> str:
        rest = "".join(f" || ' ' || w{k}" for k in range(1, n))
        return f"word{rest} AS g{n}"

    numbered = ", ".join(
        f"g{n} IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g{n} ORDER BY i) > 1 AS r{n}" for n in NGRAM_LIMITS
    )
    marked = ", ".join(
        f"coalesce(bool_or(r{n}) OVER (PARTITION BY doc_id ORDER BY i ROWS {n - 1} PRECEDING), false) AS c{n}"
        for n in sizes
    )
    sums = ", ".join(f"sum(CASE WHEN c{n} THEN chars ELSE 0 END) AS dup_chars_{n}" for n in NGRAM_LIMITS)
    out = ", ".join(f"CAST(coalesce(dup_chars_{n}, 0) AS BIGINT) AS dup_chars_{n}" for n in NGRAM_LIMITS)
    within = " AND ".join(f"100 * dup_chars_{n} <= {limit} * word_chars" for n, limit in NGRAM_LIMITS.items())
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                     generate_subscripts(string_split(text, chr(10)), 1) AS l FROM texts),
    again AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY l) > 1 AS rep,
                     regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS ws FROM lines),
    by_line AS (SELECT doc_id, count(*) FILTER (WHERE rep AND len(ws) > 0) AS n_dup_lines,
                       sum(CASE WHEN rep THEN list_sum([length(x) for x in ws]) ELSE 0 END) AS dup_line_chars
                FROM again GROUP BY doc_id),
    words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
              FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM texts)),
    led AS (SELECT doc_id, i, word, {leads} FROM words WINDOW doc AS (PARTITION BY doc_id ORDER BY i)),
    grams AS (SELECT doc_id, i, length(word) AS chars, {", ".join(gram(n) for n in sizes)} FROM led),
    flags AS (SELECT doc_id, i, chars, {numbered},
                     g3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g3) > 1 AS r3 FROM grams),
    marks AS (SELECT doc_id, chars, {marked} FROM flags),
    sums AS (SELECT doc_id, count(*) AS n_words, sum(chars) AS word_chars,
                    sum(CASE WHEN c3 THEN 1 ELSE 0 END) AS n_repeat_words, {sums} FROM marks GROUP BY doc_id),
    joined AS (
      SELECT t.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(dup_line_chars, 0) AS BIGINT) AS dup_line_chars, {out}
      FROM texts t LEFT JOIN by_line USING (doc_id) LEFT JOIN sums USING (doc_id)),
    judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM joined)
    SELECT *, NOT base_failed AND 100 * dup_line_chars <= {LINE_LIMIT} * word_chars AND {within} AS kept FROM judged
    """


SQL["op3_quality_rules"] = _repetition_sql()


VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_texts(docs, VOCABULARY, public_tokenizers.PATTERN, latin_pattern=LATIN_PATTERN, bytes_column="decoded")
    return encoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


@query
def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


SQL["op4_warc_archive"] = f"""
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p),
    f AS (SELECT *, payload_bytes >= {LEAST} AND first <> page_id AS again FROM m)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN again THEN first END AS refers_to FROM f
"""

#: Production tree and weights: four groups of sources, languages, sources.
DOMAINS = 4
MIX_WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}}
MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 60, 4, 17


def mix_path() -> dict[str, Column]:
    number = F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int") % DOMAINS
    return {"domain": F.concat(F.lit("d"), number.cast("string")), "lang": F.col("lang"), "source": F.col("source")}


@query
def op5_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mix_sources(docs, mix_path(), MIX_WEIGHTS, MIX_PERCENT, MIX_EPOCHS, MIX_SEED)
    path = [F.coalesce(c, F.lit("(none)")).alias(n) for n, c in mix_path().items()]
    return mixed.select("doc_id", *path, token_count(F.col("text")).alias("n_tokens"), "copies")


def mixture_sql(source: str = "documents", percent: int = MIX_PERCENT) -> str:
    levels = ("domain", "lang", "source")

    def weight(level: str) -> str:
        whens = "".join(f" WHEN '{v}' THEN {w}" for v, w in MIX_WEIGHTS.get(level, {}).items())
        return f"CASE {level}{whens} ELSE 1 END" if whens else "1"

    steps, given = [], ""
    for depth, level in enumerate(levels):
        keys, parents = ", ".join(levels[: depth + 1]), ", ".join(levels[:depth])
        part = f"PARTITION BY {parents}" if parents else ""
        budget = f"(SELECT budget FROM total)" if not depth else "any_value(budget)"
        join = f"JOIN {given} USING ({parents})" if depth else ""
        steps.append(f"""
    node{depth} AS (SELECT {keys}, CAST(sum(tokens) * {MIX_EPOCHS} AS BIGINT) AS cap, {weight(level)} AS w, {budget} AS budget
                    FROM leaf {join} GROUP BY {keys}),
    part{depth} AS (SELECT *, CAST(cap AS DOUBLE) / w AS ratio,
        CAST(budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS part
        FROM node{depth} WINDOW o AS ({part} ORDER BY CAST(cap AS DOUBLE) / w, {level})),
    given{depth} AS (SELECT {keys}, CASE WHEN ratio <= part THEN cap ELSE
        least(cap, CAST(floor(w * max(part) FILTER (WHERE NOT ratio <= part) OVER ({part})) AS BIGINT)) END AS budget
        FROM part{depth})""")
        given = f"given{depth}"
    return f"""
    docs AS (SELECT doc_id, coalesce('d' || CAST(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % {DOMAINS} AS VARCHAR), '(none)') AS domain,
                    coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
                    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM {source}),
    leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM docs GROUP BY ALL),
    total AS (SELECT CAST(floor(sum(tokens) * {percent} / 100) AS BIGINT) AS budget FROM leaf),
    {",".join(steps)},
    plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN CAST(budget // tokens AS BIGINT) ELSE 0 END AS epochs,
                    budget - CASE WHEN tokens > 0 THEN CAST(budget // tokens AS BIGINT) ELSE 0 END * tokens AS rest
             FROM leaf JOIN {given} USING (domain, lang, source)),
    places AS (SELECT *, md5(concat_ws(':', '{MIX_SEED}', CAST(epochs AS VARCHAR), CAST(doc_id AS VARCHAR))) AS h
               FROM docs JOIN plan USING (domain, lang, source)),
    mixed AS (SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens,
              CAST(epochs + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h) <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
              FROM places)"""


SQL["op5_source_mixture"] = f"WITH {mixture_sql()} SELECT * FROM mixed"


def doc_path() -> Column:
    """Documents as files of a tree: source, language and a folder for every hundred ids."""
    folder = F.floor(F.col("doc_id") / 100).cast("string")
    return F.concat_ws("/", "source", "lang", folder, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


@query
def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"), doc_path())


def _licence_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(
        f"({n}, {quote(name)}, {quote(term.decode())})"
        for n, (name, text) in enumerate((name, text) for name in sorted(TEMPLATES) for text in TEMPLATES[name])
        for term in terms(text.encode())
    )
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH tt(tid, name, term) AS (VALUES {values}),
    lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                     generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS l FROM documents),
    split AS (SELECT doc_id, l, regexp_extract_all(translate(line, '{upper}', '{lower}'), '[0-9a-z]+') AS ts FROM lines),
    words AS (SELECT doc_id, l, unnest(ts) AS term FROM split),
    n AS (SELECT count(*) AS n FROM documents),
    vocabulary AS (SELECT DISTINCT term FROM tt),
    df AS (SELECT v.term, count(DISTINCT doc_id) AS df FROM vocabulary v LEFT JOIN words w USING (term) GROUP BY v.term),
    weight AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS w FROM df, n),
    tf AS (SELECT tid, name, term, count(*) * any_value(w) AS v FROM tt JOIN weight USING (term) GROUP BY ALL),
    tn AS (SELECT tid, sqrt(sum(v * v)) AS norm FROM tf GROUP BY tid),
    lt AS (SELECT doc_id, l, term, count(*) AS c FROM words GROUP BY ALL),
    lv AS (SELECT doc_id, l, term, c, c * coalesce(w, ln(1 + n) + 1) AS v FROM lt LEFT JOIN weight USING (term), n),
    ln AS (SELECT doc_id, l, sqrt(sum(v * v)) AS norm, sum(c) AS terms FROM lv GROUP BY ALL),
    dot AS (SELECT doc_id, l, tid, name, sum(lv.v * tf.v) AS d FROM lv JOIN tf USING (term) GROUP BY ALL),
    cosines AS (SELECT doc_id, l, name, round(d / tn.norm / ln.norm, 6) AS cosine FROM dot JOIN tn USING (tid) JOIN ln USING (doc_id, l)),
    best AS (SELECT * FROM cosines WHERE cosine >= {LEAST_COSINE}
             QUALIFY row_number() OVER (PARTITION BY doc_id, l ORDER BY cosine DESC, name) = 1),
    own AS (SELECT doc_id, name AS own_licence, cosine FROM best
            QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, name) = 1),
    inside AS (SELECT doc_id, sum(terms) AS inside FROM best JOIN ln USING (doc_id, l) GROUP BY doc_id),
    total AS (SELECT doc_id, sum(terms) AS total FROM ln GROUP BY doc_id),
    files AS (SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id // 100 AS VARCHAR)) AS dir, CAST(doc_id AS VARCHAR) || '.txt' AS leaf,
                     own_licence, coalesce(cosine, 0.0) AS cosine,
                     own_licence IS NOT NULL AND 100 * inside >= {FILE_SHARE} * total AS licence_file
              FROM documents LEFT JOIN own USING (doc_id) LEFT JOIN inside USING (doc_id) LEFT JOIN total USING (doc_id)),
    spoken AS (SELECT dir AS ancestor, own_licence AS dir_licence FROM files WHERE licence_file
               QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, own_licence) = 1),
    dirs AS (SELECT DISTINCT dir FROM files),
    near AS (SELECT dir, ancestor, dir_licence FROM dirs JOIN spoken ON ancestor = '' OR dir = ancestor OR starts_with(dir, ancestor || '/')
             QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(ancestor) DESC) = 1)
    SELECT doc_id, dir || '/' || leaf AS path, own_licence, CAST(cosine AS DOUBLE) AS cosine, licence_file,
           coalesce(own_licence, dir_licence) AS licence, CASE WHEN own_licence IS NULL THEN ancestor END AS inherited_from
    FROM files LEFT JOIN near USING (dir)
    """


SQL["op6_licence_scan"] = _licence_sql()


@query
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.where("vec_id % 100 = 0"), vectors)


SQL["op9_exact_top_k"] = """
    WITH usable AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(1024 * x) AS BIGINT)) AS v
                    FROM embeddings
                    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] for p in list_zip(q.v, c.v)]) AS BIGINT) AS score
               FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_substrings(table(spark, sf_dir, "documents"))


SQL["op11_substring_dedup"] = f"""
    WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    places AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {LENGTH} + 2)) AS i FROM texts),
    windows AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + {LENGTH - 1}], ' ')) AS w FROM places),
    again AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
    gone AS (SELECT DISTINCT doc_id, i + unnest(range({LENGTH})) AS i FROM again),
    words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM texts),
    kept AS (SELECT doc_id, count(*) FILTER (WHERE g.i IS NOT NULL) AS n_removed,
                    coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE g.i IS NULL), '') AS kept
             FROM words LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
           sha256(coalesce(kept, '')) AS kept_sha256
    FROM texts LEFT JOIN kept USING (doc_id)
"""


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True)


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


SQL["op13_spelling_variants"] = f"""
    WITH RECURSIVE crc AS (
      SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
             lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
    by_doc AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
    bytes AS (SELECT doc_id, run, n, hex(encode(CAST(doc_id AS VARCHAR) || ':' || run)) AS x FROM by_doc),
    summed AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(x), 2),
                        lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))),
                        lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS h FROM bytes, crc),
    spelt AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
                        ELSE run END AS word FROM summed),
    words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
    places AS (SELECT word, n, unnest(range(1, length(word) + 2)) AS i FROM words),
    skips AS (SELECT word, n, substr(word, i + 1) || '$' || substr(word, 1, i - 1) AS key FROM places WHERE i <= length(word)),
    wholes AS (SELECT word, n, substr(word, i) || '$' || substr(word, 1, i - 1) AS key FROM places),
    pairs AS (
      SELECT a.word, b.word AS other, b.n AS m FROM skips a JOIN skips b ON a.key = b.key AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM skips a JOIN wholes b ON a.key = b.key
      UNION SELECT b.word, a.word, a.n FROM skips a JOIN wholes b ON a.key = b.key),
    best AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near FROM pairs
             QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1),
    forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * n THEN other END AS form,
                     CASE WHEN m >= {TIMES} * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
    chain AS (SELECT word, word AS root, form AS next FROM forms
              UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
    SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
    FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
