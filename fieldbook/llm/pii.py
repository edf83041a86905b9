"""Personal data by bootstrapped contextual extraction.

Four kinds have fixed shapes; their matches are the seeds. Every candidate (a token with digits or an at sign, groups of digits
side by side, a mail address in words) has lexical patterns: the word before or after it with its own shape, and the two words
before or after it alone, whatever its shape. Patterns and instances (normalised candidates) form a graph, which Spark scores in
a few rounds: a pattern is as good as its instances' mean belief of one kind, an instance that is no seed as good as the best
pattern that holds it, and starts from a prior. Patterns that end with high confidence and enough different instances that are
believed, mark the candidates that no fixed shape accepts.

A text is scanned in time in proportion to its length, also one of millions of characters without a blank: every pattern below starts
where a run starts and gives nothing back, and a word's neighbours are found without a second look at it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.llm.common import slices
from fieldbook.session import settled, ship

# The kinds in their order, and the shapes of the base.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Tokens that may be identifiers although no shape takes them are runs of anything but these, with four digits or more, or an at sign.
_SPLIT = "\"'<>|,;"
_MARK, _END = re.compile("[0-9@]"), re.compile(r"[\s\"'<>|,;]")
#: Groups of digits side by side, such as a national phone number.
_GROUPS = re.compile(r"(?:\((?=[0-9])|(?<![0-9]))[0-9]++(?:(?:\)[ .\-/]?|[ .\-/]\(?)[0-9]++)+")
#: The at of an address in words or with blanks, and the domain after it. What stands before it has 64 characters at most, as mail allows.
_AT = re.compile(r"\s{1,3}at\s{1,3}|\s{0,3}[\[({]\s{0,3}(?:at|@)\s{0,3}[\])}]\s{0,3}|\s{0,3}@\s{0,3}", re.IGNORECASE)
_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\s{1,3}dot\s{1,3}|\s{0,3}[\[({]\s{0,3}(?:dot|\.)\s{0,3}[\])}]\s{0,3})[A-Za-z0-9-]+)+", re.IGNORECASE)
_LOCAL_LENGTH = 64
_DIGITS = re.compile("[0-9]")
_EDGE = ".:!?()[]{}*#$%&"
_WORD = re.compile(r"\w++")
#: Words, shapes and tokens beyond this length stand in the graph as their 128-bit hash, so that they stay apart but small.
_LONG = 64


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[::-2]))
    return (odd + sum((2 * d) // 10 + (2 * d) % 10 for d in map(int, digits[-2::-2]))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and then by start; leftmost matches of a shape, those that fail its test dropped."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(x) <= 255 if len(x) < 4 else not x[:-3].strip("0") and int(x[-3:]) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def _short(x: str) -> str:
    return x if len(x) <= _LONG else f"#{xxhash.xxh3_128_hexdigest(x.encode())}"


def _shape(token: str) -> str:
    """Runs of letters and digits and what stands between: what a token looks like. Digits are few (to 3), some (to 9) or many."""
    kinds = re.sub(r"[^\W\d_]+", "a", token)
    return _short(re.sub(r"[0-9]+", lambda m: "1" if len(m[0]) < 4 else "4" if len(m[0]) < 10 else "9", kinds))


class _Neighbours:
    """The words (runs of letters and digits) of a text, found in one pass, and those next to a place by bisection."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.spans = [m.span() for m in _WORD.finditer(text)]

    def _said(self, a: int, b: int) -> str:
        """Lower-case, each run of digits as 9."""
        return _short(re.sub("[0-9]+", "9", self.text[a:b].lower()))

    def before(self, at: int) -> list[str]:
        """The two words before a place, the nearer one first; a word that the place cuts counts up to it."""
        i = bisect_left(self.spans, (at,))
        return [self._said(a, min(b, at)) for a, b in reversed(self.spans[max(0, i - 2) : i])]

    def after(self, at: int) -> list[str]:
        i = bisect_left(self.spans, (at,))
        if i and self.spans[i - 1][1] > at:
            i -= 1
        return [self._said(max(a, at), b) for a, b in self.spans[i : i + 2]]


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    while m := _MARK.search(text, done):
        a = m.start()
        while a > done and text[a - 1] not in _SPLIT and not text[a - 1].isspace():
            a -= 1
        end = _END.search(text, m.end())
        done = end.start() if end else len(text)
        yield a, done


def _candidates(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether it is a mail address or like one) of what may be an identifier although no shape takes it; they may overlap."""
    for a, b in _tokens(text):
        token = text[a:b]
        if "@" in token or sum(map(token.count, "0123456789")) >= 4:
            a, b = b - len(token.lstrip(_EDGE)), a + len(token.rstrip(_EDGE))
            if text[a:b].strip("@"):
                yield a, b, "@" in text[a:b]
    for m in _GROUPS.finditer(text):
        if 7 <= sum(map(m[0].count, "0123456789")) <= 19:
            yield *m.span(), False
    for m in _AT.finditer(text):
        a = m.start()
        while a > 0 and m.start() - a < _LOCAL_LENGTH and text[a - 1] in _LOCAL:
            a -= 1
        host = _HOST.match(text, m.end()) if a < m.start() else None
        if host:
            yield a, host.end(), True


def occurrences(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str | None, int, int, str, list[str]]]:
    """(kind or None, start, end, instance, patterns) of every base span and every candidate apart from these.

    The patterns: word before and shape; word after and shape; two words before, two words after (^ for the text's end; none if it is
    next), with no more of the token than whether it is like a mail address.
    """
    taken = sorted((a, b) for _, a, b in base)
    out = [(kind, a, b, kind == "email") for kind, a, b in base]
    k = 0
    for a, b, mail in sorted(set(_candidates(text))):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or taken[k][0] >= b:
            out.append((None, a, b, mail))
    if not out:
        return []
    found, near = [], _Neighbours(text)
    for kind, a, b, mail in out:
        token = text[a:b]
        shape = _shape(token)
        left, right = near.before(a), near.after(b)
        patterns = [f"{side}{words[0] if words else '^'} {shape}" for side, words in (("<", left), (">", right))]
        patterns += [f"{side}{'@' if mail else '9'} {' '.join([*words, '^'][:2])}" for side, words in (("2<", left), ("2>", right)) if words]
        found.append((kind, a, b, _short(token.lower()), patterns))
    return found


_ROW = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
_ROW_SQL = "array<struct<kind:string,start:bigint,end:bigint,instance:string,patterns:array<string>>>"


def _found(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("kind", "start", "end", "instance", "patterns")
    for batch in slices(source):
        texts = batch.column("_text").to_pylist()
        out = []
        for text in texts:
            text = text or ""
            out.append([dict(zip(names, x, strict=True)) for x in occurrences(text, base_spans(text))])
        keep = [x for x in batch.schema.names if x != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), pa.array(out, pa.list_(_ROW))], [*keep, "found"])


def _patterns(held: DataFrame, rounds: int, confidence: float, support: int, prior: float) -> DataFrame:
    """(pattern, trusted, score): the patterns that may be trusted with their kind, by scoring the graph of patterns and instances."""
    seen = held.select(F.explode("found").alias("f")).select("f.*")
    edges = seen.select("instance", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))
    edges = settled(edges)
    # A seed is believed whole wherever it stands; the others have the prior until a pattern with enough support says more.
    seeds = settled(edges.where("kind is not null").select("instance", "kind").distinct().withColumn("belief", F.lit(1.0)))
    unseen = edges.select("pattern", "instance").join(seeds.select("instance").distinct(), "instance", "left_anti")
    total = edges.groupBy("pattern").agg(F.count("*").alias("n")).join(unseen.groupBy("pattern").agg(F.count("*").alias("n_open")), "pattern", "left")
    belief = seeds.withColumn("seed", F.lit(True))
    # One word and a shape are what rejected look-alikes share with seeds: these patterns have no prior, and spread belief when trusted only.
    context = F.col("pattern").startswith("2")
    for _ in range(rounds):
        mass = edges.select("pattern", "instance").join(belief, "instance").groupBy("pattern", "kind").agg(F.sum("belief").alias("mass"), F.count_if(F.col("belief") >= confidence).alias("n_kind"), F.count_if(~F.col("seed")).alias("n_gained"))
        rest = F.coalesce("n_open", F.lit(0)) - F.col("n_gained")
        score = settled(mass.where(F.col("n_kind") >= support).join(total, "pattern").select("pattern", "kind", ((F.col("mass") + F.when(context, prior * rest).otherwise(0.0)) / F.col("n")).alias("score")))
        gained = unseen.join(score.where(context | (F.col("score") >= confidence)), "pattern").groupBy("instance", "kind").agg(F.max("score").alias("belief"))
        belief = seeds.withColumn("seed", F.lit(True)).union(gained.select("instance", "kind", "belief", F.lit(False)))
    good = score.where(F.col("score") >= confidence)
    return good.groupBy("pattern").agg(F.max_by("kind", F.struct("score", "kind")).alias("trusted"), F.max("score").alias("score"))


def spans_text(spans):
    """kind:start:end, by kind as listed and then by start, joined by commas."""
    place = F.transform(spans, lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(place), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, rounds: int = 3, confidence: float = 0.9, support: int = 5, prior: float = 0.2) -> DataFrame:
    """The columns `keep` (default: the id), with base and spans (arrays of kind, start, end) for every row.

    base: what the fixed shapes match; spans: these and what trusted patterns add. A pattern is trusted from a confidence of
    `confidence` and `support` different instances believed to be of its kind. An instance that is no seed starts at `prior`; with the
    defaults, a context is trusted by itself if at least half of its different instances are seeds of one kind. Of added spans that
    hold each other the longest stays. Null and empty texts have none; very long texts are scanned whole, in time that grows with their
    length times its logarithm; repeated rows are separate rows with equal results; an empty table gives an empty result. Columns of docs other than these don't matter.
    """
    ship(docs.sparkSession)
    keep = [id_col] if keep is None else keep
    own = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    marked = own.mapInArrow(_found, ", ".join([*(f"`{c}` {kinds[c]}" for c in own.columns if c != "_text"), f"found {_ROW_SQL}"]))
    slim = marked.select("_row", *(f"_k{i}" for i, c in enumerate(keep) if c != text_col), "found")
    held = settled(slim)
    trusted = settled(_patterns(held, rounds, confidence, support, prior))
    open_ = held.where(F.exists("found", lambda f: f["kind"].isNull())).select("_row", F.explode("found").alias("f")).where("f.kind is null")
    sides = open_.select("_row", "f.start", "f.end", F.explode("f.patterns").alias("pattern")).join(trusted, "pattern")
    added = sides.groupBy("_row", "start", "end").agg(F.max_by("trusted", F.struct("score", "trusted")).alias("kind"))
    earlier = Window.partitionBy("_row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    added = added.withColumn("reach", F.max("end").over(earlier)).where("reach is null or end > reach")
    more = added.groupBy("_row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    base = F.transform(F.filter("found", lambda f: f["kind"].isNotNull()), lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
    joined = held.withColumn("base", base).join(more, "_row", "left")
    return joined.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "base", F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))).alias("spans"))


def pii_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of the base spans, and all spans."""
    found = find_pii(docs, id_col, text_col)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(id_col, *map(count, KINDS), F.sha2(F.encode(spans_text(F.col("base")), "UTF-8"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def _masked(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(source):
        out = []
        for text, spans in zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
            if text and spans:
                parts, at = [], 0
                for a, b, kind in sorted((s["start"], s["end"], s["kind"]) for s in spans):
                    if b > at:
                        parts += [text[at : max(a, at)], f"[{kind.upper()}]"]
                        at = b
                text = "".join([*parts, text[at:]])
            out.append(text)
        keep = [x for x in batch.schema.names if x not in ("_text", "_spans")]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), pa.array(out, pa.string())], [*keep, "_masked"])


def mask_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with every span replaced by its kind in brackets, such as [EMAIL]; rows, columns and their order stay.

    Spans find their text again by id and the text's hash, null-safe, so repeated rows are masked alike. Null and empty texts stay as they are,
    very long ones are masked whole; an empty table gives an empty result.
    """
    spans = find_pii(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.xxhash64(text_col).alias("_mark")), "_id", "_t", ["_id", "_mark"], **options)
    spans = spans.where(F.size("spans") > 0).select("_id", "_mark", F.col("spans").alias("_spans")).dropDuplicates(["_id", "_mark"])
    rest = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != text_col}
    own = docs.select(*(F.col(c).alias(p) for c, p in rest.items()), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"))
    own = own.join(spans, F.col(rest[id_col]).eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_mark")), "left").select(*rest.values(), "_text", "_spans")
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in own.schema if f.name in rest.values()]
    masked = own.mapInArrow(_masked, ", ".join([*kinds, "_masked string"]))
    return masked.select(*(F.col("_masked" if c == text_col else rest[c]).alias(c) for c in docs.columns))
