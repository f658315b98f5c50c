"""Personal data by weak supervision, in DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; their valid matches
always stay. Looser patterns propose more spans: secrets, national phone numbers, account and
insurance numbers, addresses in words. Labelers (the shape of the span, a gazetteer of words before
it, the characters around it, the mix of characters in it) vote for or against each, or abstain.
Expectation-maximisation over the counts of the vote patterns estimates how reliable each labeler
is; the resulting probabilities train a logistic classifier over features of the span, which
decides. Only pattern counts reach the driver: 3 to the power of the labelers at most, and 2 to
the power of the features.

Positions count code points, ends are exclusive. Possessive quantifiers and a look-behind keep the
patterns linear on long runs; neither changes a match, since every start within a run of the same
class succeeds or fails with the first one.

Defined results: a null or empty text has no spans; with no proposals at all none are added;
equal rows give equal results; other columns are carried on unchanged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the method finds come after the base ones.
ALL_KINDS = (*KINDS, "secret", "account")

PATTERNS = {
    "email": (
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
    ),
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this can't hold a match, which saves the pattern.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

PROPOSALS = {
    "email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}+"
    r"(?: ?[(\[]dot[)\]] ?[A-Za-z0-9-]{2,20}+){1,4}+",
    "account": r"(?<![A-Za-z0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|"
    r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9-])",
    "phone": r"(?<![0-9+(.-])(?:(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
    r"|0[0-9]{2,4}[ .-][0-9]{3,4}[ .-][0-9]{3,4})(?![0-9])",
    # Keys with signs in them hold small and capital letters and digits; others are one run.
    "secret": r"(?<![A-Za-z0-9_+/=.-])(?=[A-Za-z_+/=.-]*+[0-9])(?=[A-Z0-9_+/=.-]*+[a-z])"
    r"(?=[a-z0-9_+/=.-]*+[A-Z])[A-Za-z0-9_+/=-]{20,}+(?:\.[A-Za-z0-9_+/=-]{8,}+)*+"
    r"|(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{12,}+",
}

#: Words that name what follows them.
GAZETTEER = (
    "password", "passwd", "pwd", "token", "secret", "key", "apikey", "credential", "auth",
    "phone", "tel", "telephone", "mobile", "cell", "fax", "call", "mail", "email", "contact",
    "account", "iban", "ssn", "security", "insurance", "passport", "card",
)
CONTEXT_CHARS = 24
CHUNK = 512


def running_sums(values: Column) -> Column:
    """Sums of the entries before each one; works in chunks, so a long array isn't squared."""
    zero = F.lit(0).cast("long")

    def total(array: Column) -> Column:
        return F.aggregate(array, zero, lambda a, x: a + x)

    count = F.ceil(F.size(values) / CHUNK).cast("int")
    # Not an if-then: the sequence must not run backwards for an empty array.
    numbers = F.filter(F.sequence(F.lit(0), count), lambda k: k < count)
    chunks = F.transform(numbers, lambda k: F.slice(values, k * CHUNK + 1, F.lit(CHUNK)))
    totals = F.transform(chunks, total)
    before = F.transform(totals, lambda _, k: total(F.slice(totals, F.lit(1), k)))
    inside = F.transform(
        chunks, lambda c: F.transform(c, lambda _, i: total(F.slice(c, F.lit(1), i)))
    )
    shifted = F.zip_with(inside, before, lambda c, b: F.transform(c, lambda x: x + b))
    return F.when(F.size(values) > 0, F.flatten(shifted)).otherwise(F.array().cast("array<bigint>"))


def with_matches(df: DataFrame, name: str, pattern: str, needed: Column) -> DataFrame:
    """Column ``name``: all matches as structs of start, end, text, before and after."""
    text = F.col("text")
    hit = needed & text.rlike(pattern)
    none = F.array().cast("array<string>")
    df = df.withColumns(
        {
            "m": F.when(hit, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(none),
            "p": F.when(hit, F.split(text, pattern, -1)).otherwise(none),
        }
    )
    sizes = F.zip_with("p", "m", lambda p, m: (F.length(p) + F.length(m)).cast("long"))
    df = df.withColumn("sums", running_sums(F.slice(sizes, F.lit(1), F.size("m"))))

    def one(m: Column, i: Column) -> Column:
        piece = F.get("p", i)
        start = F.get("sums", i) + F.length(piece)
        return F.struct(
            start.alias("start"),
            (start + F.length(m)).alias("end"),
            m.alias("text"),
            F.right(piece, F.lit(CONTEXT_CHARS)).alias("before"),
            F.left(F.get("p", i + 1), F.lit(CONTEXT_CHARS)).alias("after"),
        )

    return df.withColumn(name, F.transform("m", one)).drop("m", "p", "sums")


def valid(kind: str, match: Column) -> Column:
    """The check that a base match must pass."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        parts = F.split(match, r"\.")
        short = lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.forall(
            parts,
            lambda part: (F.length(short(part)) <= 3)
            & (F.coalesce(short(part).try_cast("int"), F.lit(999)) <= 255),
        )
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def tagged(column: str, kind: str, base: bool) -> Column:
    return F.transform(
        column,
        lambda m: F.struct(
            F.lit(kind).alias("kind"),
            F.lit(ALL_KINDS.index(kind)).alias("rank"),
            m["start"].alias("start"),
            m["end"].alias("end"),
            m["text"].alias("text"),
            m["before"].alias("before"),
            m["after"].alias("after"),
            F.lit(base).alias("base"),
            (valid(kind, m["text"]) if base else F.lit(False)).alias("valid"),
        ),
    )


def searched(df: DataFrame) -> DataFrame:
    """Adds ``base`` (all matches of the base patterns) and ``proposed`` (those of the looser)."""
    digits = F.col("text").rlike("[0-9]")
    for kind in KINDS:
        need = NEEDS[kind]
        needed = F.col("text").contains(need) if need else digits
        df = with_matches(df, f"base_{kind}", PATTERNS[kind], needed)
    for kind in PROPOSALS:
        if kind == "email":
            needed = F.col("text").contains("at)") | F.col("text").contains("at]")
        else:
            needed = digits
        df = with_matches(df, f"more_{kind}", PROPOSALS[kind], needed)
    base = F.concat(*[tagged(f"base_{kind}", kind, True) for kind in KINDS])
    more = F.concat(*[tagged(f"more_{kind}", kind, False) for kind in PROPOSALS])
    df = df.withColumn("base", base).withColumn("more", more)
    df = df.drop(*[f"base_{kind}" for kind in KINDS], *[f"more_{kind}" for kind in PROPOSALS])
    # Proposals that touch a valid base span are no spans of their own; of those that overlap
    # each other the first by kind stays.
    df = df.withColumn("good", F.filter("base", lambda b: b["valid"]))

    def free(c: Column) -> Column:
        return ~F.exists("good", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

    def foremost(c: Column) -> Column:
        return ~F.exists(
            "more",
            lambda b: (b["start"] < c["end"])
            & (c["start"] < b["end"])
            & (b["rank"] < c["rank"]),
        )

    df = df.withColumn("proposed", F.filter("more", lambda c: free(c) & foremost(c)))
    return df.drop("more")


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def labelers(c: Column) -> dict[str, Column]:
    """Votes of 1, -1 or 0 on a candidate span."""
    text, before = c["text"], c["before"]
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    switches = F.size(F.split(text, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", -1))
    named = before.rlike(r"(?i)(?:^|[^a-z])(?:" + "|".join(GAZETTEER) + r")[^a-z]{0,8}$")
    return {
        "shape": vote(
            (c["base"] & c["valid"])
            | text.rlike(r"^(?:AKIA[A-Z0-9]{16}|[0-9a-f]{16,}|[0-9]{3}-[0-9]{2}-[0-9]{4}"
                         r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|0[0-9]{2,4}[ .-][0-9]{3,4}[ .-][0-9]{3,4})$")
            | text.rlike("^(?:gh[a-z]_|sk-|[ps]k_|xox[a-z]-|eyJ)")
            | text.rlike(r"[(\[]at[)\]]"),
            c["base"] & ~c["valid"],
        ),
        "gazetteer": vote(named, F.lit(False)),
        "context": vote(
            before.rlike(r"[=:\"'(]\s?$"), before.rlike(r"[A-Za-z0-9/_-]$") | c["after"].rlike("^[A-Za-z0-9/_]")
        ),
        "mixture": vote(
            (switches >= 4) | (digits >= 9),
            (F.length(text) - digits > 2 * digits) & (switches <= 2) & ~text.contains("@"),
        ),
    }


def features(c: Column) -> dict[str, Column]:
    """What the final classifier looks at, as 0 or 1."""
    text = c["text"]
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    out = {f"kind_{k}": c["kind"] == k for k in ALL_KINDS}
    out |= {
        "long": F.length(text) >= 16,
        "mostly_digits": digits * 2 >= F.length(text),
        "upper": text.rlike("^[A-Z0-9]+$"),
        "hex": text.rlike("^[0-9a-f]+$"),
        "marked": c["before"].rlike(r"[=:\"'(]\s?$"),
        "named": c["before"].rlike(r"(?i)(?:" + "|".join(GAZETTEER) + r")[^a-z]{0,8}$"),
        "apart": c["before"].rlike(r"(?:^|\s)$"),
        "invalid": c["base"] & ~c["valid"],
    }
    return {name: F.coalesce(value, F.lit(False)).cast("int") for name, value in out.items()}


FEATURES = (
    *(f"kind_{k}" for k in ALL_KINDS),
    "long", "mostly_digits", "upper", "hex", "marked", "named", "apart", "invalid",
)
LABELERS = ("shape", "gazetteer", "context", "mixture")


@dataclass(frozen=True)
class Model:
    prior: float
    #: For each labeler the probabilities of -1, 0, 1 if the span is personal data, and if not.
    reliability: dict[str, tuple[tuple[float, ...], tuple[float, ...]]]
    weights: dict[str, float]
    bias: float

    def accepts(self, c: Column) -> Column:
        found = features(c)
        score = F.lit(self.bias)
        for name in FEATURES:
            score = score + found[name] * F.lit(self.weights[name])
        return score > 0


def patterns(found: DataFrame) -> list[tuple[tuple[int, ...], tuple[int, ...], int]]:
    """Votes, features and how many candidates have them."""
    spans = found.select(F.explode(F.concat("base", "proposed")).alias("c"))
    c = F.col("c")
    votes, marks = labelers(c), features(c)
    # One number each: three values a labeler, two a feature.
    vote_code = F.lit(0)
    for name in LABELERS:
        vote_code = vote_code * 3 + votes[name] + 1
    mark_code = F.lit(0)
    for name in FEATURES:
        mark_code = mark_code * 2 + marks[name]
    counts = spans.select(vote_code.alias("v"), mark_code.alias("f")).groupBy("v", "f").count()
    out = []
    for row in counts.collect():
        v, f = row["v"], row["f"]
        digits = []
        for _ in LABELERS:
            v, digit = divmod(v, 3)
            digits.append(digit - 1)
        bits = [(f >> k) & 1 for k in range(len(FEATURES))]
        out.append((tuple(reversed(digits)), tuple(reversed(bits)), row["count"]))
    return sorted(out)


def fit(
    counted: list[tuple[tuple[int, ...], tuple[int, ...], int]],
    rounds: int = 50,
    steps: int = 400,
) -> Model:
    """Reliabilities of the labelers by expectation-maximisation, then the span classifier."""
    total = sum(n for _, _, n in counted)
    prior = 0.5
    # Labelers start as better than chance; that tells the two classes apart.
    yes = [[0.1, 0.3, 0.6] for _ in LABELERS]
    no = [[0.5, 0.4, 0.1] for _ in LABELERS]
    by_votes: dict[tuple[int, ...], int] = {}
    for votes, _, n in counted:
        by_votes[votes] = by_votes.get(votes, 0) + n

    def posterior(votes: tuple[int, ...]) -> float:
        a, b = math.log(prior), math.log(1 - prior)
        for k, v in enumerate(votes):
            a += math.log(yes[k][v + 1])
            b += math.log(no[k][v + 1])
        return 1 / (1 + math.exp(min(700.0, b - a)))

    for _ in range(rounds if total else 0):
        chance = {votes: posterior(votes) for votes in by_votes}
        mass = sum(chance[v] * n for v, n in by_votes.items())
        prior = min(0.99, max(0.01, (mass + 1) / (total + 2)))
        for k in range(len(LABELERS)):
            a, b = [0.6, 1.8, 3.6], [3.0, 2.4, 0.6]
            for votes, n in by_votes.items():
                a[votes[k] + 1] += chance[votes] * n
                b[votes[k] + 1] += (1 - chance[votes]) * n
            yes[k] = [x / sum(a) for x in a]
            no[k] = [x / sum(b) for x in b]
    weights, bias = [0.0] * len(FEATURES), -1.0 if not total else 0.0
    rows = [(marks, posterior(votes), n / max(total, 1)) for votes, marks, n in counted]
    for _ in range(steps):
        slope, flat = [1e-4 * w for w in weights], 0.0
        for marks, target, share in rows:
            z = bias + sum(w for w, on in zip(weights, marks, strict=True) if on)
            gap = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - target) * share
            flat += gap
            for k, on in enumerate(marks):
                if on:
                    slope[k] += gap
        bias -= 2 * flat
        weights = [w - 2 * s for w, s in zip(weights, slope, strict=True)]
    return Model(
        prior,
        {name: (tuple(yes[k]), tuple(no[k])) for k, name in enumerate(LABELERS)},
        dict(zip(FEATURES, weights, strict=True)),
        bias,
    )


def texts_of(docs: DataFrame, columns: list[str], text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit("")).alias("text")
    return docs.select(F.struct(*columns).alias("row"), text)


def train(docs: DataFrame, text_column: str = "text") -> Model:
    """Model from the candidates of all documents."""
    return fit(patterns(searched(texts_of(docs, [text_column], text_column))))


def spans(
    docs: DataFrame, model: Model, columns: list[str], text_column: str = "text"
) -> DataFrame:
    """``row`` (struct of the named columns), ``text``, ``good`` (base spans) and ``all_spans``,
    both sorted by start, then kind."""
    found = searched(texts_of(docs, columns, text_column))
    added = F.filter("proposed", model.accepts)

    def plain(column) -> Column:
        short = F.transform(
            column,
            lambda c: F.struct(
                c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), c["kind"].alias("kind")
            ),
        )
        return F.array_sort(short)

    return found.select(
        "row", "text", plain("good").alias("good"), plain(F.concat("good", added)).alias("all_spans")
    )


def listed(column: str) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def count_of(kind: str) -> Column:
    return F.size(F.filter("good", lambda s: s["kind"] == kind)).cast("long")


def masked() -> Column:
    """The text with every span replaced by its kind in angle brackets."""

    def step(state: Column, span: Column) -> Column:
        gap = F.substring("text", (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        tag = F.concat(F.lit("<"), F.upper(span["kind"]), F.lit(">"))
        new = span["start"] >= state["at"]
        return F.named_struct(
            F.lit("at"),
            F.greatest(state["at"], span["end"]),
            F.lit("out"),
            F.when(new, F.concat(state["out"], gap, tag)).otherwise(state["out"]),
        )

    start = F.named_struct(F.lit("at"), F.lit(0).cast("long"), F.lit("out"), F.lit(""))

    def finish(state: Column) -> Column:
        rest = F.substring("text", (state["at"] + 1).cast("int"), F.length("text"))
        return F.concat(state["out"], rest)

    return F.when(F.size("all_spans") > 0, F.aggregate("all_spans", start, step, finish)).otherwise(
        F.col("text")
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with personal data masked; ``n_chars`` is set anew where the
    text changed. A null text stays null."""
    found = spans(docs, train(docs), docs.columns)
    changed = F.size("all_spans") > 0
    new = found.select("row", changed.alias("changed"), masked().alias("masked"))
    own = {name: F.col("row")[name] for name in docs.columns}
    own["text"] = F.when(F.col("changed"), F.col("masked")).otherwise(own["text"])
    if "n_chars" in own:
        kind = docs.schema["n_chars"].dataType
        own["n_chars"] = F.when(F.col("changed"), F.length("masked").cast(kind)).otherwise(own["n_chars"])
    return new.select(*[value.alias(name) for name, value in own.items()])
