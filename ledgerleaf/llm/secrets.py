"""Secrets in texts: candidates by shape, false positives removed by a random forest.

A candidate is a value assigned to a name that holds a key word (``DB_PASSWORD``,
``clientSecret``), a password in a URL, a private key or a run of token characters. The forest judges it by length, character transitions, share covered by
dictionary words, character classes, the path of its document and the words around it. It
learns from labelled findings: a given table, or the built-in ones, which are drawn from
the shapes below by a fixed seed. Each tree is learned in a task of its own.

Null text counts as empty and has no findings; a null path counts as empty. Scanning is
narrow, over whole texts, without a bound on findings.
"""

from __future__ import annotations

import base64
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm.bpe import small_batches

#: Labelled findings of each label at most, trees, their depth, rows of a leaf.
TRAIN_ROWS, TREES, DEPTH, LEAF_ROWS, SEED = 2_000, 32, 9, 4, 11
SECRET = 0.5
#: Characters of context on either side.
NEAR = 48

#: Names that hold a key word, whole, with the mark of an assignment. Possessive, so a name is read once.
NAME = r"(?=[A-Za-z0-9_.-]++[\"']?\s*+[:=])(?=[A-Za-z0-9_.-]*?(?i:pass(?:word|wd|phrase)|pwd|secret|token|key|auth|credential|bearer|private|access|client|signing))[A-Za-z0-9_.-]++[\"']?\s*+(?:=>|:=|=|:)"
#: Values after such names, but not further names or URLs, which are read by themselves; passwords in URLs; private keys.
ASSIGNED = re.compile(
    r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----.*?-----END (?:[A-Z]+ )*PRIVATE KEY-----"
    rf"|(?<![A-Za-z0-9_.-]){NAME}\s*+(?![A-Za-z][A-Za-z0-9+.-]*+://|{NAME}\s*[^\s=])"
    r"(?:\"(?P<double>[^\"\s]{6,})\"|'(?P<single>[^'\s]{6,})'|(?P<bare>[^\s\"'`<>,;)\]}]{8,}))"
    r"|://[^\s/:@\"'<>]*+:(?P<login>[^\s/\"'<>]+)@",
    re.S,
)
#: Runs of token characters anywhere else.
RUN = re.compile(r"(?<![A-Za-z0-9!#$%&*+/_.-])[A-Za-z0-9!#$%&*+/_.-]{10,}(?:={1,2}[!#$%&*]*+)?(?![A-Za-z0-9!#$%&*+/_-])")
#: Repeated marks that decorate words; a value is judged by its longest part between them, and masked whole.
MARKS = re.compile(r"([!#$%&*])\1{2,}|([!#$%&*])\2\Z")
ISSUED = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}$|gh[pousr]_[A-Za-z0-9]{30,}$|xox[abprs]-[A-Za-z0-9-]{10,}$|sk_(?:live|test)_[A-Za-z0-9]{16,}$|AIza[A-Za-z0-9_-]{30,}$|eyJ[\w-]+\.eyJ[\w-]+\.[\w-]+$|-----BEGIN")
#: Neighbouring words for and against a secret, and parts of paths with made-up values.
FOR = "token secret key apikey password passwd pwd passphrase auth authorization bearer credential credentials private access client signing".split()
AGAINST = "sha sha1 sha256 md5 hash checksum digest commit revision integrity etag uuid guid id build version file path image href src url invoice order card phone isbn".split()
MADE_UP = "test tests example examples sample fixture fixtures mock mocks docs doc spec demo template".split()
WORDS = (
    "about access account action address after again agent allow animal another answer apple application around array author basic because before begin better between black block board body "
    "book branch bridge bring brown build button cache call center change check child city class clear client close cloud code color column command common company config connect content control "
    "copy count country create current data default define delete demo design detail device digital direct display document domain driver early earth engine enter error event every example export "
    "field figure file filter final find first folder follow form format found frame from function general get green group handler hash head hello help here high history home house image import "
    "index info input insert install issue item join key language large last layer letter level library light limit line link list little load local login long machine main manager market master "
    "memory message method minute mobile model module money month morning mother name network never new night node normal number object open option order other output page paper parent password path pattern people "
    "place plain point power press price process product profile program project public question queue quick random read record region release remote report request reset resource response result return right river "
    "root route sample save schema school screen script search second secret section select send server service session simple small some source space special stage start state status store stream string strong "
    "student style summer support system table target team template test text their theme there thing think time title token tool total train tree type under unit update upload user value version video view "
    "water website week while white window winter with word work world write year young your"
).split()


@cache
def transitions() -> np.ndarray:
    """Log probability of each pair of neighbouring letters in words (others: letter 26)."""
    table = np.full((27, 27), 0.5)
    for w in WORDS:
        code = [ord(c) - 97 for c in w]
        for a, b in zip([26, *code], [*code, 26]):
            table[a, b] += 1
    return np.log(table / table.sum(axis=1, keepdims=True))


@cache
def known_words() -> re.Pattern:
    return re.compile("|".join(sorted({w for w in WORDS if len(w) > 3}, key=len, reverse=True)))


def features(value: str, before: str, after: str, path: str) -> list[float]:
    low, n = value.lower(), len(value)
    code = [ord(c) - 97 if "a" <= c <= "z" else 26 for c in low]
    table = transitions()
    pairs = [table[a, b] for a, b in zip(code, code[1:]) if a < 26 or b < 26]
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "o" for c in value]
    counts, letters = Counter(kind), Counter(value)
    near = set(re.findall(r"[a-z]+[0-9]*", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", before).lower())[-4:])
    for_key = any(w in FOR for x in near for w in (x, x.rstrip("s")))
    return [
        n,
        sum(pairs) / max(len(pairs), 1),
        sum(len(m) for m in known_words().findall(low)) / n,
        counts["d"] / n,
        counts["u"] / n,
        counts["o"] / n,
        sum(a != b for a, b in zip(kind, kind[1:])) / n,
        -sum(c / n * math.log2(c / n) for c in letters.values()),
        len(letters) / n,
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", value))),
        float(bool(ISSUED.match(value))),
        float(for_key),
        float(bool(near & set(AGAINST))),
        float(bool(re.search(r"[=:]>?\s*[\"']?$", before))),
        float(before[-1:] in "\"'" and before[-1:] != "" and after[:1] in "\"'" and after[:1] != ""),
        float(bool(re.search(r"/|\.[a-z]{2,4}$|://", low))),
        float(bool(set(re.split(r"[^a-z]+", path.lower())) & set(MADE_UP))),
        float(bool(re.search(r"(.)\1{4,}|1234|abcd|your|example|change|dummy|xxxx|placeholder|\.\.\.", low))),
    ]


def labelled_findings(rows: int = TRAIN_ROWS, seed: int = SEED) -> list[tuple[str, str, str, str, int]]:
    """``value, before, after, path, label``: as many real as false ones, drawn by a fixed seed."""
    rng = random.Random(seed)
    pick = lambda letters, n: "".join(rng.choices(letters, k=n))
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    words = lambda n, sep: sep.join(rng.choices(WORDS, k=n))
    case = lambda s: s.upper() if rng.random() < 0.15 else s
    prose = lambda: " ".join(pick(string.ascii_lowercase, rng.randint(2, 9)) for _ in range(5))
    real = [
        lambda: pick(hexes, rng.choice((32, 40, 40, 48, 64))),
        lambda: pick(alnum, rng.randint(18, 44)),
        lambda: base64.b64encode(rng.randbytes(rng.randint(15, 40))).decode(),
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
        lambda: rng.choice(("ghp_", "sk_live_", "xoxb-")) + pick(alnum, 36),
        lambda: pick(alnum + "!#%&*+-_", rng.randint(10, 20)),
    ]
    false = [
        lambda: (words(rng.randint(2, 4), rng.choice(("_", "-", ".", ""))), prose()),
        lambda: ("".join(w.title() for w in rng.choices(WORDS, k=rng.randint(3, 5))), prose()),
        lambda: (words(rng.randint(2, 5), "/") + rng.choice((".py", ".html", ".png", "")), rng.choice(("path ", "file = ", "src=\""))),
        lambda: (pick(string.digits, rng.randint(13, 20)), rng.choice((prose(), "card number", "phone: ", "order "))),
        lambda: (pick(hexes, rng.choice((32, 40, 64))), rng.choice(("commit ", "sha256: ", "md5 = \"", "checksum: ", "etag: \"", "integrity=", "revision "))),
        lambda: ("-".join(pick(hexes, n) for n in (8, 4, 4, 4, 12)), rng.choice(("id: ", "uuid = \"", "guid "))),
        lambda: (rng.choice(("your_api_key_here", "xxxxxxxxxxxxxxxx", "changeme123456", "example-token-value", "placeholder_secret", "1234567890abcdef", "aaaaaaaaaaaaaaaa", "dummy_password_123")), rng.choice(("token = \"", "api_key: ", "password=\""))),
        lambda: (words(1, "") + rng.choice(("", "1", "123")), rng.choice(("password = \"", "token: "))),
        lambda: (".".join(str(rng.randint(0, 255)) for _ in range(5)), rng.choice(("version ", prose()))),
        lambda: ("".join(pick(string.ascii_lowercase, 3) for _ in range(7)), prose()),
        lambda: (pick(alnum, 24), "https://example.com/" + words(2, "/") + "/"),
        lambda: ("-" * rng.randint(16, 60), prose()),
        lambda: ("=" * rng.randint(16, 60), prose()),
        lambda: ("www." + words(2, "-") + ".example.com/" + words(1, ""), prose()),
    ]
    out = []
    for _ in range(rows):
        value = case(rng.choice(real)())
        key = rng.choice(FOR) + rng.choice(("", "_key", "Key", "s"))
        start = f"{prose()} {case(key)} {rng.choice(('=', ':', '=>', ''))} ".replace("  ", " ")
        quote = rng.choice(("\"", "'", ""))
        if rng.random() < 0.1:
            start, quote = prose() + " ", ""
        out.append((value, start + quote, quote + rng.choice((" ", "###", "!! ", "\n", ", ")) + prose(), rng.choice(("", "src/app/config", "src3")), 1))
        value, start = rng.choice(false)()
        quote = start[-1:] if start[-1:] == "\"" else ""
        out.append((case(value), f"{prose()} {start}" + ("" if start.endswith(("\"", "/", "=")) else " "), quote + " " + prose(), rng.choice(("", "docs/example", "tests/fixtures", "src7")), 0))
    for _ in range(rows // 20):  # passwords in URLs
        start, host = f"{prose()} {rng.choice(('https', 'postgres', 'redis', 'ftp'))}://{words(1, '')}:", f"@{words(1, '')}.{rng.choice(('com', 'net'))}/{words(1, '')}"
        out.append((pick(alnum + "!#%&*+-_", rng.randint(8, 20)), start, host, rng.choice(("", "src/app/config")), 1))
        out.append((rng.choice(("password", "pass", "changeme", "your_password", words(1, ""))), start, host, rng.choice(("", "docs/example")), 0))
    return out


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """Nodes ``feature, bound, left, right, share`` of one tree; feature -1 in leaves."""
    nodes: list[tuple[int, float, int, int, float]] = []

    def grow(at: np.ndarray, depth: int) -> int:
        me, share = len(nodes), float(y[at].mean())
        nodes.append((-1, 0.0, -1, -1, share))
        if depth == DEPTH or len(at) < 2 * LEAF_ROWS or share in (0.0, 1.0):
            return me
        best = (share * (1 - share) * len(at) - 1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], max(2, int(math.sqrt(x.shape[1]))), replace=False).tolist():
            order = at[np.argsort(x[at, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            cut = cut[(cut + 1 >= LEAF_ROWS) & (len(at) - cut - 1 >= LEAF_ROWS)]
            if len(cut):
                n, left = cut + 1.0, ones[cut]
                right = ones[-1] - left
                loss = left * (1 - left / n) + right * (1 - right / (len(at) - n))
                k = int(loss.argmin())
                if loss[k] < best[0]:
                    best = (float(loss[k]), f, float((v[cut[k]] + v[cut[k] + 1]) / 2))
        _, f, bound = best
        if f >= 0:
            low = x[at, f] <= bound
            left = grow(at[low], depth + 1)
            nodes[me] = (f, bound, left, grow(at[~low], depth + 1), share)
        return me

    grow(rng.integers(0, len(y), len(y)), 0)
    return nodes


class Forest:
    """Mean of the trees' leaf shares."""

    def __init__(self, trees: list[np.ndarray]):
        self.trees = [(t[:, 0].astype(np.int64), t[:, 1], t[:, 2:4].astype(np.int64), t[:, 4]) for t in trees]

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, bound, child, share in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                down = f >= 0
                at = np.where(down, child[at, (x[rows, np.maximum(f, 0)] > bound[at]).astype(np.int64)], at)
            out += share[at]
        return out / max(len(self.trees), 1)


def fit(spark: SparkSession, labelled: DataFrame | None = None) -> Forest:
    """Forest from labelled findings (``value, before, after, path, label``); at most TRAIN_ROWS of each label, by hash."""
    given = None
    if labelled is not None:
        known = labelled.filter("value IS NOT NULL AND value <> '' AND label IS NOT NULL")
        order = [F.xxhash64("value", "before"), "value"]
        parts = [known.filter(F.col("label") == y).orderBy(*order).limit(TRAIN_ROWS) for y in (0, 1)]
        given = [(r.value, r.before or "", r.after or "", r.path or "", int(r.label)) for r in parts[0].unionByName(parts[1]).collect()]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for b in batches:
            for tree in b.column(0).to_pylist():
                table = table or given or labelled_findings()
                x = np.array([features(*r[:4]) for r in table])
                y = np.array([r[4] for r in table], float)
                grown = np.array(_grow(x, y, np.random.default_rng(SEED + tree)), float)
                yield pa.RecordBatch.from_arrays([pa.array([tree]), pa.array([grown.tobytes()])], names=["tree", "nodes"])

    rows = spark.range(0, TREES, 1, min(TREES, 8)).mapInArrow(learn, "tree bigint, nodes binary").collect()
    return Forest([np.frombuffer(r.nodes).reshape(-1, 5) for r in sorted(rows)])


def _spans(text: str) -> Iterator[tuple[int, int, bool]]:
    """``start, end, assigned`` of every candidate, in text order; runs are looked for between the assigned values."""
    at = 0
    for m in ASSIGNED.finditer(text):
        yield from ((*r.span(), False) for r in RUN.finditer(text, at, m.start()))
        start, at = next((m.span(g) for g in ("double", "single", "bare", "login") if m[g]), m.span())
        end = at
        if m["bare"] and text[m.start() - 1 : m.start()] in ("?", "&"):  # parameters of a query
            end = at = start + len(m["bare"].split("&")[0])
        yield start, end, True
    yield from ((*r.span(), False) for r in RUN.finditer(text, at))


def _core(text: str, start: int, end: int) -> tuple[int, int]:
    """The longest part between repeated marks, without a final stop; the whole value if there is no part of 6 characters."""
    best, a = (start, start), start
    for m in MARKS.finditer(text, start, end):
        best, a = max(best, (a, m.start()), key=lambda s: s[1] - s[0]), m.end()
    a, b = max(best, (a, end), key=lambda s: s[1] - s[0])
    while b > a and text[b - 1] == ".":
        b -= 1
    return (a, b) if b - a >= 6 else (start, end)


def candidates(text: str, path: str) -> list[tuple[int, int, list[float]]]:
    """``start, end, features`` of every candidate; overlapping ones don't occur."""
    out = []
    for start, end, assigned in _spans(text):
        a, b = _core(text, start, end)
        core = text[a:b]
        if assigned or not (core.isalpha() and (core.islower() or len(core) < 10 or len(core) < 16 and core.istitle()) or len(core) < 8):
            out.append((start, end, features(core, text[max(0, a - NEAR) : a], text[b : b + NEAR], path)))
    return out


def _judged(texts: list[str | None], paths: list[str | None], forest: Forest) -> list[list[tuple[int, int, float]]]:
    found = [candidates(t or "", p or "") for t, p in zip(texts, paths)]
    flat = [f for c in found for *_, f in c]
    score = iter(forest.score(np.array(flat)).tolist() if flat else [])
    return [[(a, b, next(score)) for a, b, _ in c] for c in found]


def scan(docs: DataFrame, forest: Forest, id_column: str = "doc_id", text_column: str = "text", path_column: str = "source") -> DataFrame:
    """One row a candidate: ``id_column, start, end, value, score, secret``; start and end count code points."""
    kind = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # bounded by TREES and DEPTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts = b.column(1).to_pylist()
            rows = [(k, a, e, texts[k][a:e], s) for k, found in enumerate(_judged(texts, b.column(2).to_pylist(), shared.value)) for a, e, s in found]
            at, start, end, value, score = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(value, pa.string()), pa.array(score, pa.float64())],
                names=["id", "start", "end", "value", "score"],
            )

    held = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), F.col(path_column).cast("string").alias("path"))
    rows = held.mapInArrow(run, f"id {kind}, start bigint, end bigint, value string, score double")
    return rows.select(F.col("id").alias(id_column), "start", "end", "value", "score", (F.col("score") >= SECRET).alias("secret"))


def redacted(docs: DataFrame, forest: Forest, text_column: str = "text", path_column: str = "source", length_column: str = "n_chars", mask: str = "[SECRET]") -> DataFrame:
    """The same rows with every secret replaced; the length column follows where text changed. Clean rows stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("string")
    def clean(text: pd.Series, path: pd.Series) -> pd.Series:
        texts = [None if t is None or t != t else t for t in text]
        out = []
        for t, found in zip(texts, _judged(texts, [None if p is None or p != p else p for p in path], shared.value)):
            for a, b, s in reversed(found):
                if s >= SECRET:
                    t = t[:a] + mask + t[b:]
            out.append(t)
        return pd.Series(out, dtype=object)

    own = F.col(text_column)
    masked = docs.withColumn("__masked", clean(own.cast("string"), F.col(path_column).cast("string")))
    columns = []
    for c in docs.columns:
        if c == text_column:
            columns.append(F.col("__masked").alias(c))
        elif c == length_column:
            columns.append(F.when(own == F.col("__masked"), F.col(c)).otherwise(F.when(own.isNull(), F.col(c)).otherwise(F.length("__masked").cast(docs.schema[c].dataType))).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return masked.select(*columns)
