"""Personal data: base expressions, and contextual extraction bootstrapped from what they find.

Seeds are the base spans (email, ip, card, phone) and secrets of two plain forms (hexadecimal, access key ids). Candidates are all other runs of six
characters or more that look like identifiers: those with a digit, a sign such as @ _ / + or a capital after a small
letter, quoted or bracketed runs of any form, and digits in groups. Each seed and each candidate is an occurrence of an
instance in lexical patterns of several widths: two words before, one word before and the words on both sides with any filler; one word before and one word after with
fillers of one shape; a shape of many parts, the form, or the beginning and the length, alone. Spark scores the
graph of patterns and instances in rounds. A pattern is as reliable as the share that trusted ones have of its
distinct instances (copies of a text add nothing), where seeds of other kinds count in full and those of which nothing is known
by a quarter; patterns of enough trusted instances above a confidence trust the instances that stand in them (by the square of their score), and those count in the next round,
wherever they stand, so that patterns which no seed supports can follow. In the end confident patterns discover the unseen
instances in their slots, by the kind of the best pattern. Base spans always stay.

Defined cases: a null text is empty; offsets are code points; rows are told apart even where all their columns
repeat; texts are read whole; an empty table gives an empty result; other columns are ignored. Candidates that
touch a seed, or lie within a longer group of digits, are left out.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_tables, materialize, table

KINDS = ("email", "ip", "card", "phone", "secret")
#: Rounds of scoring, confidence of a pattern that discovers, distinct instances that it needs, and what an instance
#: of which nothing is known counts against a pattern, where one of another kind counts 1.
ROUNDS, CONFIDENCE, SUPPORT, DOUBT = 3, 0.9, 5, 0.25
#: Least characters of a candidate; characters of a word, of punctuation and of a shape before a digest stands for them.
LEAST, LONG, GLUE = 6, 80, 16
#: Characters of a shape up to which it says too little to be a pattern by itself, as 0, a or a-0 do.
PLAIN = 4

# The base expressions, written so that none is tried again within a run of characters: very long runs take
# linear time. What follows a possessive part is never of its class, and an address can't start amid digits.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
#: What ends a run, and what tokens of contexts lie between.
_BREAK = "\"'<>()[\\]{}|,;="
_STOPS = frozenset("\"'<>()[]{}|,;=")
RUN, TOKEN = re.compile(rf"[^\s{_BREAK}]++"), re.compile(rf"[^\s{_BREAK}:.!?]++")
#: The first sign of an identifier; it begins with its class, which a search can look for quickly.
SIGN = re.compile(r"[0-9@_/+~A-Z](?:(?<=[0-9@_/+~])|(?<=[a-z][A-Z]))")
QUOTED = re.compile(rf"[\"'<(\[{{](?=([^\s{_BREAK}]{{{LEAST},}}+)[\"'>)\]}}])")
#: Seeds of secrets: hexadecimal numbers of digits and letters, and the public form of access key ids.
SECRET, LAST = re.compile(r"[0-9a-f]{16,}+|AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"), re.compile(rf"[.:!?]*+(?=[\s{_BREAK}]|\Z)")
#: Digits in groups, as cards and phones have them, and the padding of base64.
GROUPS = re.compile(r"\+?[0-9](?:[\x20\xa0 -]?[0-9])++")
BASE64, PADDING = re.compile(r"[A-Za-z0-9+/_-]++"), re.compile(r"={1,2}(?!=)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`: for each @ what stands before it and after it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, leftmost and non-overlapping within a kind; matches that fail their test are dropped."""
    out: dict[str, list[tuple[int, int]]] = {"email": [], "ip": [], "card": [], "phone": []}
    out["email"] = emails(text)
    if DIGITS.search(text):
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15]
    return out


def _short(s: str, most: int = LONG) -> str:
    """The string, or a digest of one of more than so many characters."""
    return s if len(s) <= most else "~" + xxhash.xxh3_64_hexdigest(s.encode("utf-8", "surrogatepass"))


def form(s: str) -> str:
    """Letters, capitals and digits by class, each for itself; long hexadecimal numbers by their length."""
    return _short(re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "0", re.sub(r"[0-9a-f]{32,}+", lambda m: f"#{len(m[0])}", s)))))


def shape(s: str) -> str:
    """Runs of digits, of long hexadecimal numbers and of letters by class; other characters stay."""
    return _short(re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]", "0", re.sub(r"[A-Za-z]", "a", re.sub(r"[0-9a-f]{32,}+", "#", s)))))


class Contexts:
    """Patterns of the spans of a text; its tokens are found once, and each is folded where a span needs it."""

    def __init__(self, text: str):
        self.text, spans = text, [m.span() for m in TOKEN.finditer(text)]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def _token(self, i: int) -> str:
        """Lower case, runs of digits as one 0; '' beyond either end."""
        return _short(DIGITS.sub("0", self.text[self.starts[i] : self.ends[i]].lower())) if 0 <= i < len(self.starts) else ""

    def _glue(self, a: int, b: int) -> str:
        return _short(re.sub(r"\s+", " ", self.text[a:b]), GLUE)

    def of(self, start: int, end: int) -> list[str]:
        """The patterns that a span stands in, each named by its width; _ marks the span."""
        i, j = bisect.bisect_right(self.ends, start) - 1, bisect.bisect_left(self.starts, end)
        text, filler = self.text, self.text[start:end]
        one, two, after = self._token(i), self._token(i - 1), self._token(j)
        before = self._glue(self.ends[i] if i >= 0 else 0, start)
        behind = self._glue(end, self.starts[j] if j < len(self.starts) else len(text))
        left, right = (x if not x.isspace() else " " for x in (text[start - 1 : start] if start else "", text[end : end + 1]))
        own, whole = shape(filler), form(filler)
        return [
            f"2 {two} {one}{before}_{right}", f"1 {one}{before}_{right}", f"both {one}{before}_{behind}{after}",
            f"1 {one}{before}_{right} as {own}", f"after {left}_{behind}{after} as {own}", f"form {whole}",
            f"begins {filler[:4]} of {end - start}", *([f"shape {own}"] if len(own) > PLAIN else []),
        ]


def _free(spans: list[tuple[int, int]]):
    """Whether a span touches none of the given ones."""
    spans = sorted(spans)
    starts, reach = [a for a, _ in spans], []
    for _, b in spans:
        reach.append(max(b, reach[-1]) if reach else b)

    def free(a: int, b: int) -> bool:
        i = bisect.bisect_left(starts, b)
        return not i or reach[i - 1] <= a

    return free


def seeds(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base spans and of the secrets that lie outside of them."""
    out = [(a, b, kind) for kind, spans in base.items() for a, b in spans]
    free = _free([x[:2] for x in out])
    for m in SECRET.finditer(text):
        a, b = m.span()
        if (not a or text[a - 1].isspace() or text[a - 1] in _STOPS) and LAST.match(text, b) and free(a, b):
            digits = sum(map(len, DIGITS.findall(m[0])))
            if m[0][0] == "A" or 2 < digits < b - a - 2:
                out.append((a, b, "secret"))
    return out


def runs(text: str) -> list[tuple[int, int]]:
    """Spans of the runs between breaks that look like identifiers or are quoted, without .:!? at the end but with the padding of base64."""
    out, end, sign = [], 0, SIGN.search(text)
    while sign:
        a, b = sign.start(), RUN.match(text, sign.start()).end()
        while a > end and text[a - 1] not in _STOPS and not text[a - 1].isspace():
            a -= 1
        end = b
        while text[b - 1] in ".:!?":
            b -= 1
        if b == end and text[b : b + 1] == "=" and (pad := PADDING.match(text, b)) and (pad.end() - a) % 4 == 0 and BASE64.fullmatch(text, a, b):
            end = b = pad.end()
        if b - a >= LEAST:
            out.append((a, b))
        sign = SIGN.search(text, end)
    known = set(out)
    return out + [m.span(1) for m in QUOTED.finditer(text) if m.span(1) not in known]


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, kinds) of what may be discovered outside of the taken spans, none within another; kinds: '' for all."""
    plain = runs(text)
    found, known = [(a, b, "") for a, b in plain], set(plain)
    found += [(*m.span(), "card,phone") for m in GROUPS.finditer(text) if not m[0].isdigit() and 9 <= sum(c.isdigit() for c in m[0]) <= 19 and m.span() not in known]
    if "+" in text:
        found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 6 <= sum(c.isdigit() for c in m[0]) <= 19 and m.span() not in known]
    free, out, end = _free(taken), [], 0
    for a, b, kinds in sorted((x for x in found if free(*x[:2])), key=lambda x: (x[0], -x[1], x[2])):
        if a >= end:
            out.append((a, b, kinds))
            end = b
        elif b > end and b - a > end - out[-1][0]:  # a longer one that begins within the last
            out[-1], end = (a, b, kinds), b
    return out


def number(s: str) -> int:
    """64 bits of an instance."""
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def hidden(instance: int, fifths: int) -> bool:
    """Whether an instance is withheld from the seeds, for trials: of the last fifths of five equal parts."""
    return instance % 5 >= 5 - fifths


def occurrences(text: str, base: dict[str, list[tuple[int, int]]], masked: int = 0) -> list[dict]:
    """Seeds and candidates with their patterns; seeds that masked withholds are candidates like others."""
    own = [(a, b, kind) for a, b, kind in seeds(text, base) if not masked or not hidden(number(text[a:b]), masked)]
    spans = [(a, b, kind, "") for a, b, kind in own] + [(a, b, "", kinds) for a, b, kinds in candidates(text, [x[:2] for x in own])]
    if not spans:
        return []
    contexts = Contexts(text)
    return [{"kind": kind, "kinds": kinds, "instance": number(text[a:b]), "start": a, "stop": b, "patterns": contexts.of(a, b)} for a, b, kind, kinds in sorted(spans)]


_FOUND = "found array<struct<kind:string,kinds:string,instance:long,start:int,stop:int,patterns:array<string>>>"


def scan(docs: DataFrame, masked: int = 0) -> DataFrame:
    """A row for each document: base spans, and the occurrences that bootstrapping works on."""
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("kinds", pa.string()), ("instance", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("patterns", pa.list_(pa.string()))]))

    def run(batches):
        for b in batches:
            counts, spans, found = [[], [], [], []], [], []
            for text in b.column("text").to_pylist():
                base = base_spans(text)
                for i, kind in enumerate(KINDS[:4]):
                    counts[i].append(len(base[kind]))
                spans.append(",".join(f"{kind}:{a}:{z}" for kind in KINDS[:4] for a, z in base[kind]))
                found.append(occurrences(text, base, masked))
            cols = {"doc_id": b.column("doc_id")} | {f"n_{k}": pa.array(c, pa.int64()) for k, c in zip(KINDS, counts, strict=False)}
            yield pa.RecordBatch.from_pydict(cols | {"base": pa.array(spans, pa.string()), "found": pa.array(found, found_type)})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, {_FOUND}")


_FITS = "kinds = '' OR contains(kinds, kind)"


def score_patterns(seen: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """pattern, kind, score, instances of the confident patterns. seen: pattern, instance, kind ('' for candidates), kinds."""
    one = seen.groupBy("pattern", "instance").agg(F.max("kind").alias("own"), F.min("kinds").alias("kinds"))
    counted = materialize(one, "pii-graph")
    # A pattern of fewer instances than it needs can't become confident, so it may go at once.
    totals = counted.groupBy("pattern").agg(F.count("*").alias("total"), F.count_if(F.col("own") != "").alias("seeded"))
    totals = materialize(totals.where(F.col("total") >= support), "pii-totals")
    edges = materialize(counted.join(totals, "pattern", "left_semi"), "pii-edges")
    sure = materialize(edges.where("own <> ''").select("instance", F.col("own").alias("kind"), F.lit(1.0).alias("trust")).distinct(), "pii-seeds")
    trusted, scored = sure, None
    for _ in range(rounds):
        used = [trusted] if trusted is not sure else []
        # An instance is one of a kind wherever it stands, as a seed or not.
        rated = edges.join(trusted, "instance").where(_FITS)
        sums = rated.groupBy("pattern", "kind").agg(F.sum("trust").alias("s"), F.count_if(F.col("own") == F.col("kind")).alias("o"), F.count("*").alias("instances"))
        sums = sums.where(F.col("instances") >= support)
        other, unknown = F.col("seeded") - F.col("o"), F.col("total") - F.col("seeded") - (F.col("s") - F.col("o"))
        score = F.col("s") / (F.col("s") + other + DOUBT * F.greatest(unknown, F.lit(0)))
        before = scored
        scored = materialize(sums.join(totals, "pattern").select("pattern", "kind", score.alias("score"), "instances").where(F.col("score") >= confidence), "pii-patterns")
        gained = edges.where("own = ''").join(scored, "pattern").where(_FITS).groupBy("instance", "kind").agg((F.max("score") * F.max("score")).alias("trust"))
        trusted = materialize(sure.union(gained).groupBy("instance", "kind").agg(F.max("trust").alias("trust")), "pii-trusted")
        drop_tables(*used, *([before] if before is not None else []))
    drop_tables(counted, totals, edges, sure, trusted)
    return scored


def find_pii(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT, masked: int = 0) -> DataFrame:
    """doc_id, counts of base spans, base (string) and added: spans that confident patterns discovered.

    masked: fifths of the seeds' instances that are withheld and left to be discovered, for trials."""
    rows = materialize(scan(docs, masked).withColumn("_row", F.monotonically_increasing_id()), "pii-scan")
    seen = rows.select("_row", F.explode("found").alias("f")).select("_row", "f.*")
    each = seen.withColumn("pattern", F.explode("patterns")).drop("patterns")
    sure = score_patterns(each.select("pattern", "instance", "kind", "kinds"), rounds, support, confidence)
    # Seeds that are no base span are added where a pattern of theirs is confident, and what isn't a seed by its best one.
    slots = each.where("kind = '' OR kind = 'secret'").withColumnRenamed("kind", "own").join(sure, "pattern").where(f"({_FITS}) AND (own = '' OR own = kind)")
    new = slots.groupBy("_row", "start", "stop").agg(F.max(F.struct("score", "kind")).alias("best"))
    added = new.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "stop", F.col("best.kind").alias("kind")))).alias("added"))
    return rows.drop("found").join(added, "_row", "left").drop("_row")


def op9_pii_bootstrap(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, then n_secret and n_added (discovered spans) and n_spans (all spans)."""
    found = find_pii(table(spark, sf_dir, "documents"))
    found = found.withColumn("added", F.coalesce("added", F.array().cast("array<struct<start:int,stop:int,kind:string>>")))

    def of(kind: str):
        """The spans of one kind, by start."""
        base = F.filter(F.split("base", ","), lambda x: x.startswith(kind + ":"))
        new = F.transform(F.filter("added", lambda x: x["kind"] == kind), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string")))
        placed = F.transform(F.array_distinct(F.concat(base, new)), lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("a"), x.alias("x")))
        return F.transform(F.array_sort(placed), lambda y: y["x"])

    spans = F.array_join(F.concat(*[of(k) for k in KINDS]), ",")
    n_added = F.size("added").cast("long")
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"),
        F.size(F.filter("added", lambda x: x["kind"] == "secret")).cast("long").alias("n_secret"), n_added.alias("n_added"),
        (F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone") + n_added).alias("n_spans"),
    )
