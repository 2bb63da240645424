"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base findings are regular-expression matches. Splitting a text by a pattern gives the pieces
between its matches, so running lengths give each match's place in code points.

A further candidate is a long token that mixes letters and digits and is no base finding. Its hash
is counted over the distinct repositories and owners that hold it, in the whole corpus. A candidate
or finding that several owners share, or that one owner has put into more than ``REPOSITORIES``
repositories, is an example that gets copied; any other looks live. Live candidates join the spans under the
kind ``owned``.

Counting goes from (hash, owner, repository) to hash, so a value found in a third of all rows is
reduced before it meets anything. Rows are joined by a digest of their text, so null and repeated
ids are safe; equal texts have equal findings. Null texts are empty texts without findings. A null
owner or repository counts as one owner or repository of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import query, read, stored, text_key, text_of

# The patterns of the base findings and their least lengths.
ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Tokens of 20 and more characters; kept if they have letters and at least four digits.
OWNED = r"[A-Za-z0-9+/_=-]{20,}"
#: A live credential is in few repositories of its owner.
REPOSITORIES = 3
KINDS = ("assign", "access", "hex", "owned")
MASK = "<secret>"


def matches(text: Column, pattern: str, value_group: int = 0) -> Column:
    """Array of (start, end, value): leftmost non-overlapping matches, in code points."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if not value_group else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    rows = F.arrays_zip(
        F.slice(pieces, 1, F.size(found)).alias("piece"), found.alias("found"), values.alias("value")
    )
    start = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<struct<start:int,end:int,value:string>>").alias("spans"),
    )

    def step(state: Column, row: Column) -> Column:
        first = state["at"] + F.length(row["piece"])
        last = first + F.length(row["found"])
        span = F.struct(first.alias("start"), last.alias("end"), row["value"].alias("value"))
        return F.struct(last.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    spans = F.aggregate(rows, start, step, lambda state: state["spans"])
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def of_kind(spans: Column, kind: int) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"),
            s["value"].alias("value"),
        ),
    )


def base_spans(text: Column) -> dict[str, Column]:
    assigned = F.filter(matches(text, ASSIGN, 2), lambda s: F.length(s["value"]) >= ASSIGN_LEAST)
    return {
        "assign": of_kind(assigned, 0),
        "access": of_kind(matches(text, ACCESS), 1),
        "hex": of_kind(matches(text, HEX), 2),
    }


def listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def ownership(found: DataFrame) -> DataFrame:
    """(value) -> (repos, owners): distinct holders in the whole corpus."""
    holders = found.groupBy("value", "owner", "repo").agg(F.lit(1).alias("one"))
    per_owner = holders.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    return per_owner.groupBy("value").agg(
        F.sum("repos").alias("repos"), F.count("*").alias("owners")
    )


def scan(docs: DataFrame, owner_col: str = "source", repo_col: str = "lang") -> DataFrame:
    """Per row: counts, digest of base spans, all spans, how many spans look live or copied, and the most
    owners and repositories that hold one of its spans (0 without spans).

    ``owner_col`` names the owner; owner and ``repo_col`` together name the repository.
    """
    text = F.col("text")
    named = docs.select(
        "doc_id", text_of().alias("text"), text_key().alias("text_key"),
        F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"),
    )
    parts = named.select(
        "doc_id", "text_key", "owner", "repo",
        *(c.alias(n) for n, c in base_spans(text).items()),
        of_kind(matches(text, OWNED), 3).alias("long"),
    )
    base = F.array_sort(F.concat("assign", "access", "hex"))
    parts = parts.select(
        "doc_id", "text_key", "owner", "repo",
        F.size("assign").cast("bigint").alias("n_assign"),
        F.size("access").cast("bigint").alias("n_access"),
        F.size("hex").cast("bigint").alias("n_hex"),
        base.alias("base"), "long",
    )
    mixed = F.filter(
        "long",
        lambda s: s["value"].rlike(r"[A-Za-z]") & s["value"].rlike(r"(?:[0-9][^0-9]*){4}"),
    )
    parts = parts.withColumn(
        "extra",
        F.filter(
            mixed,
            lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
        ),
    ).drop("long")
    parts = stored(parts)
    found = parts.select(
        "text_key", "owner", "repo", F.explode(F.concat("base", "extra")).alias("span")
    ).select("text_key", "owner", "repo", "span", F.xxhash64("span.value").alias("value"))
    frequency = ownership(found)
    alive = (F.col("owners") == 1) & (F.col("repos") <= REPOSITORIES)
    judged = (
        found.groupBy("text_key", "span", "value").agg(F.lit(1).alias("one"))
        .join(frequency, "value")
        .groupBy("text_key")
        .agg(
            F.collect_list(F.when((F.col("span.kind") == 3) & alive, F.col("span"))).alias("live"),
            F.sum(F.when(alive, 1).otherwise(0)).alias("n_live"),
            F.sum(F.when(~alive & (F.col("span.kind") < 3), 1).otherwise(0)).alias("n_copied"),
            F.max("owners").alias("owners"), F.max("repos").alias("repos"),
        )
    )
    joined = parts.join(judged, "text_key", "left")
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    every = F.array_sort(F.concat("base", F.coalesce("live", nothing)))
    return joined.select(
        "doc_id", "text_key", "n_assign", "n_access", "n_hex",
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(every).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("bigint").alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).cast("bigint").alias("n_copied"),
        F.coalesce("owners", F.lit(0)).cast("bigint").alias("owners"),
        F.coalesce("repos", F.lit(0)).cast("bigint").alias("repos"),
        every.alias("found"),
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced; overlapping spans share one mask."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        gap = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], gap, F.lit(MASK))).otherwise(state["out"]).alias("out"),
        )

    return F.aggregate(
        spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, 2**31 - 1))
    )


def mask_secrets(docs: DataFrame, owner_col: str = "source", repo_col: str = "lang") -> DataFrame:
    """The documents with all findings masked; other columns, and texts without findings, stay."""
    hits = (
        scan(docs, owner_col, repo_col).where("size(found) > 0")
        .groupBy("text_key").agg(F.first("found").alias("spans"))
    )
    # the document's own columns stay in one struct, so their names cannot clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text_key().alias("text_key"))
    text = F.col("row.text")
    text = F.when(F.col("spans").isNull(), text).otherwise(masked(text, F.col("spans")))
    return rows.join(hits, "text_key", "left").select(
        *(text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns)
    )


def _sql() -> str:
    """The same rows in DuckDB; its case-insensitive flag knows more letters, so both are spelt out."""
    either = "|".join(
        "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
        for word in ("password", "passwd", "secret", "token", "api_?key")
    )
    assign = (f"({either})" + ASSIGN[ASSIGN.index("[") :]).replace("'", "''")
    kinds = " UNION ALL ".join(
        f"""SELECT r, owner, repo, {k} AS kind, regexp_extract_all(t, '{pattern}') AS f,
        regexp_extract_all(t, '{pattern}', {group}) AS v, string_split_regex(t, '{pattern}') AS p
        FROM d WHERE regexp_matches(t, '{pattern}')"""
        for k, pattern, group in ((0, assign, 2), (1, ACCESS, 0), (2, HEX, 0), (3, OWNED, 0))
    )
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
        {{'owner': source}} AS owner, {{'owner': source, 'repo': lang}} AS repo FROM documents),
    m AS ({kinds}),
    x AS (SELECT *, unnest(generate_series(1, len(f))) AS i FROM m),
    s AS (SELECT r, owner, repo, kind, v[i] AS value, length(f[i]) AS n,
        CAST(list_sum(list_transform(p[1 : i], lambda y: length(y)))
          + coalesce(list_sum(list_transform(f[1 : i - 1], lambda y: length(y))), 0) AS BIGINT) AS a FROM x),
    b AS (SELECT * FROM s WHERE kind IN (1, 2) OR kind = 0 AND length(value) >= {ASSIGN_LEAST}),
    e AS (SELECT * FROM s WHERE kind = 3 AND regexp_matches(value, '[A-Za-z]')
        AND regexp_matches(value, '([0-9][^0-9]*){{4}}')
        AND NOT EXISTS (FROM b WHERE b.r = s.r AND b.a < s.a + s.n AND s.a < b.a + b.n)),
    o AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM (FROM b UNION ALL FROM e) GROUP BY value),
    j AS (SELECT u.*, owners, repos, owners = 1 AND repos <= {REPOSITORIES} AS alive, ([{names}])[kind + 1] || ':' || a || ':' || (a + n) AS span
        FROM (FROM b UNION ALL FROM e) u JOIN o USING (value)),
    g AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
        count(*) FILTER (kind = 2) AS n_hex,
        string_agg(span, ',' ORDER BY a, kind) FILTER (kind < 3) AS base,
        string_agg(span, ',' ORDER BY a, kind) FILTER (kind < 3 OR alive) AS spans,
        count(*) FILTER (alive) AS n_live, count(*) FILTER (NOT alive AND kind < 3) AS n_copied,
        max(owners) AS owners, max(repos) AS repos
        FROM j GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
      coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
      coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
      coalesce(owners, 0) AS owners, coalesce(repos, 0) AS repos
    FROM d LEFT JOIN g USING (r)"""


@query("op6_secret_scans", _sql())
def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied", "owners", "repos"
    )
