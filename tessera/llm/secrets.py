"""Secret scans: credential patterns and a randomness test battery, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize, table

#: Fixed patterns, Java syntax: kind, pattern. The access and hex patterns carry the minimum
#: length: a run is matched whole, so a run that is too short has no longer match inside.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
#: A whole run of 20 or more token characters, with its padding. An inner "=" parts two runs.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}=*"
#: The same for the parts of a run that has no encoding as a whole, in either base64 alphabet.
PARTS = (r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}", r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20,}")

#: Index of coincidence (sum of squared letter frequencies) of the letters of natural text.
COINCIDENCE = 0.0655
#: Encodings in the order they are tried: name, pattern of the whole token, alphabet, and the
#: excess k * sum(p^2) - 1 of structured text over uniform text in an alphabet of k characters:
#: decimal numbers where the alphabet is hexadecimal, natural text elsewhere.
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef", 16 / 10 - 1),
    ("HEX", r"^[0-9A-F]+$", "0123456789ABCDEF", 16 / 10 - 1),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32 * COINCIDENCE - 1),
    ("base36", r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 36 * COINCIDENCE - 1),
    ("base64", r"^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 64 * COINCIDENCE - 1),
    ("base64url", r"^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 64 * COINCIDENCE - 1),
)


@dataclass(frozen=True)
class SecretConfig:
    """``rate`` is the false-discovery rate in each length band, ``bands`` their least lengths. A token whose
    sequence a random string would show with a probability under ``reject`` has no weight."""

    rate: float = 0.01
    reject: float = 0.001
    bands: tuple[int, ...] = (20, 32, 64)


def _spans(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches, as structs (start, kind, stop).

    The gaps between the matches and their lengths, summed up, give the places in code points.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.expr("cast(array() as array<struct<start:int,kind:int,stop:int,value:string>>)")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        stop = start + F.length(pair["match"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), pair["match"].alias("value"))
        good = F.length(F.regexp_extract(pair["match"], pattern, value_group)) >= least if least else F.lit(True)
        return F.struct(stop.alias("at"), F.when(good, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda s: s["out"])).otherwise(none)


def normal_below(z: Column) -> Column:
    """P(N(0, 1) <= z), with small relative error in the lower tail (Abramowitz-Stegun 7.1.26)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = 0.5 * poly * F.exp(-x * x)
    return F.when(z < 0, tail).otherwise(1 - tail)


def _tests(value: Column) -> Column:
    """Length, the battery's three p-values of one token in its encoding, and the three combined.

    ``p_structured``: a structured string of this length and alphabet would be as uniform as
    the token (lower tail of the chi-squared statistic around its noncentral mean; longer
    tokens separate better). ``p_runs``, ``p_serial``: a random string would have such runs
    above and below the middle of the alphabet, or such a correlation of neighbours. The last two don't
    depend on the composition. By Fisher's method they give ``p_sequence``, uniform for random strings and small for
    ordered ones, so twice it is a weight of mean 1 at most, and ``p`` = ``p_structured`` over this weight goes into
    the weighted false-discovery control (Genovese, Roeder and Wasserman, 2006).
    """
    body, alphabet, k, excess = value["body"], value["code"]["alphabet"], value["code"]["k"], value["code"]["excess"]
    n = F.length(body).cast("double")
    chars = F.split(body, "")
    squares = F.aggregate(
        F.transform(F.array_distinct(chars), lambda c: F.pow(F.length(body) - F.length(F.replace(body, c, F.lit(""))), F.lit(2))),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    chi = squares * k / n - n
    z_structured = (chi - (k - 1) - excess * n) / F.sqrt(2 * ((k - 1) + 2 * excess * n))
    places = value["places"]
    ups = F.aggregate(places, F.lit(0), lambda s, p: s + (p >= k / 2).cast("int")).cast("double")
    pairs = F.zip_with(F.slice(places, 1, F.size(places) - 1), F.slice(places, 2, F.size(places) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    runs = 1 + F.aggregate(pairs, F.lit(0), lambda s, x: s + ((x["a"] >= k / 2) != (x["b"] >= k / 2)).cast("int"))
    mu = 1 + 2 * ups * (n - ups) / n
    z_runs = (runs - mu) / F.sqrt(F.greatest((mu - 1) * (mu - 2) / (n - 1), F.lit(1e-9)))
    m = (k - 1) / 2
    cross = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + (x["a"] - m) * (x["b"] - m))
    power = F.aggregate(places, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
    z_serial = cross / F.greatest(power, F.lit(1e-9)) * F.sqrt(n)
    return F.struct(
        F.length(body).alias("length"),
        normal_below(z_structured).alias("p_structured"),
        (2 * normal_below(-F.abs(z_runs))).alias("p_runs"),
        (2 * normal_below(-F.abs(z_serial))).alias("p_serial"),
    )


def _combined(t: Column, config: SecretConfig) -> Column:
    both = F.least(F.greatest(t["p_runs"] * t["p_serial"], F.lit(1e-300)), F.lit(1.0))
    sequence = both * (1 - F.log(both))
    return F.when(sequence >= config.reject, F.least(F.lit(1.0), t["p_structured"] / (2 * sequence))).otherwise(1.0)


def _encoding(body: Column) -> Column:
    """The first encoding whose pattern the whole token has, as (alphabet, k, excess)."""
    rows = [
        (body.rlike(pattern), F.struct(F.lit(alphabet).alias("alphabet"), F.lit(float(len(alphabet))).alias("k"), F.lit(excess).alias("excess")))
        for _, pattern, alphabet, excess in ENCODINGS
    ]
    out = F.when(*rows[0])
    for row in rows[1:]:
        out = out.when(*row)
    return out


def _parts(run: Column) -> Column:
    """The parts of a run in one alphabet each, at their places in the text; a last one has the run's padding."""

    def moved(p: Column) -> Column:
        last = p["stop"] == F.length(run["body"])
        return F.struct(
            (run["start"] + p["start"]).alias("start"),
            run["kind"].alias("kind"),
            F.when(last, run["stop"]).otherwise(run["start"] + p["stop"]).alias("stop"),
            p["value"].alias("body"),
            _encoding(p["value"]).alias("code"),
        )

    return F.concat(*(F.transform(_spans(run["body"], pattern, 3), moved) for pattern in PARTS))


def _merged(spans: Column) -> Column:
    """Spans with those that overlap made one: a run's parts in the two alphabets may do so."""

    def step(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        both = F.struct(last["start"].alias("start"), s["kind"].alias("kind"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(both))
        return F.when(F.size(out) == 0, F.array(s)).when(s["start"] < last["stop"], joined).otherwise(F.concat(out, F.array(s)))

    none = F.expr("cast(array() as array<struct<start:int,kind:int,stop:int>>)")
    return F.when(F.size(spans) > 1, F.aggregate(F.array_sort(spans), none, step)).otherwise(spans)


def _band(length: Column, config: SecretConfig) -> Column:
    out = F.lit(-1)
    for i, least in enumerate(config.bands):
        out = F.when(length >= least, i).otherwise(out)
    return out


def find_spans(docs: DataFrame, config: SecretConfig = SecretConfig(), keep: tuple[str, ...] = (), own: str = "") -> DataFrame:
    """``doc_id``, the columns in ``keep``, and ``base`` and ``added`` spans of every text; ``own`` begins their names.

    Candidates of the battery are scored in one pass over the texts and written; the
    false-discovery threshold of each length band comes from counts of the p-values' tenths of
    a decade over the whole corpus, a table of bounded size, by the Benjamini-Hochberg rule.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = F.array_sort(F.concat(_spans(text, ASSIGN, 0, 1, 6), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))
    candidates = _spans(text, CANDIDATE, 3)
    # one step after the other, so that no expression is written out more than once
    span = lambda s: (s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))
    bodies = F.transform(candidates, lambda s: F.struct(*span(s), F.regexp_replace(s["value"], "=+$", "").alias("body")))
    whole = F.transform(bodies, lambda s: F.struct(*span(s), s["body"].alias("body"), _encoding(s["body"]).alias("code")))
    coded = F.flatten(F.transform(whole, lambda s: F.when(s["code"].isNotNull(), F.array(s)).otherwise(_parts(s))))
    placed = F.transform(
        coded,
        lambda s: F.struct(
            *span(s),
            s["body"].alias("body"),
            s["code"].alias("code"),
            F.transform(F.split(s["body"], ""), lambda c: F.call_function("instr", s["code"]["alphabet"], c).cast("double") - 1).alias("places"),
        ),
    )
    scored = F.transform(placed, lambda s: F.struct(*span(s), _tests(s).alias("t")))
    # the combined p-value is computed once per token, as the only element of an array
    compact = F.flatten(
        F.transform(
            scored,
            lambda s: F.transform(
                F.array(_combined(s["t"], config)),
                lambda p: F.struct(
                    *span(s),
                    _band(s["t"]["length"], config).alias("band"),
                    F.least(F.lit(3000), F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-300))))).cast("int").alias("level"),
                ),
            ),
        )
    )
    bare = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    found = materialize(docs.select("doc_id", *keep, bare.alias(f"{own}base"), compact.alias(f"{own}candidates")), "secret-spans")
    counts = found.select(F.explode(f"{own}candidates").alias("c")).groupBy("c.band", "c.level").count().collect()
    threshold = {b: _benjamini_hochberg({r["level"]: r["count"] for r in counts if r["band"] == b}, config.rate) for b in range(len(config.bands))}

    def accepted(c: Column) -> Column:
        passes = F.lit(False)
        for band, level in threshold.items():
            passes = passes | ((c["band"] == band) & (c["level"] >= level))
        return passes & ~F.exists(f"{own}base", lambda s: (s["start"] < c["stop"]) & (c["start"] < s["stop"]))

    added = F.transform(
        F.filter(f"{own}candidates", accepted), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))
    )
    return found.select("doc_id", *keep, f"{own}base", _merged(added).alias(f"{own}added"))


def _benjamini_hochberg(levels: dict[int, int], rate: float) -> int:
    """The least level (tenths of -log10 p, rounded down) that may be discovered.

    p is taken at the level's upper end, so rounding never admits more than the exact rule.
    """
    m, seen, least = sum(levels.values()), 0, 1 << 30
    for level in sorted(levels, reverse=True):
        seen += levels[level]
        if 10 ** (-level / 10) <= rate * seen / m:
            least = level
    return least


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def secret_scan(docs: DataFrame, config: SecretConfig = SecretConfig()) -> DataFrame:
    """Spans of secrets in each row of ``docs(doc_id, text, ...)``, as counts and digests.

    Null texts count as empty and have no span. Places are code points, ends exclusive. Spans
    of kind ``random`` that meet a base span are left out. Repeated rows each return; other
    columns are not read. An empty table gives an empty result.
    """
    spans = find_spans(docs.select("doc_id", "text"), config)
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return spans.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.size("added").cast("long").alias("n_random"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", config: SecretConfig = SecretConfig()) -> DataFrame:
    """``docs`` with each maximal stretch of secret spans replaced by ``mark``.

    Rows, repeated ones too, columns of any other names and texts without a span, null ones too, stay as they are;
    ``n_chars``, if present, is set anew. An empty table gives an empty result.
    """
    own = "_sc_"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    base, added = f"{own}base", f"{own}added"
    spans = find_spans(docs, config, tuple(c for c in docs.columns if c != "doc_id"), own)
    text = F.col("text").cast("string")

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        meets = span["start"] < state["at"]
        out = F.when(meets, state["out"]).otherwise(F.concat(state["out"], gap, F.lit(mark)))
        return F.struct(F.greatest(state["at"], span["stop"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(
        F.array_sort(F.concat(base, added)), start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    )
    new = F.when(F.size(base) + F.size(added) > 0, clean).otherwise(text)
    out = spans.withColumn("text", new).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
