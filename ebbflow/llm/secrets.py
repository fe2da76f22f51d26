"""Operator 7, secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are, of whole texts: runs of 16 or more characters of ``[A-Za-z0-9_+/=.-]`` with a digit; the whole value,
quoted or up to a blank, of 6 to 200 characters of any kind that is assigned to a word which names a
credential (a short password is thus one too, and marks don't cut it); and blocks between ``-----BEGIN ...-----`` and
its end. Where candidates overlap the widest stands for all. Below 6 characters a value is too short
to be told from a word. Features are length, character transitions and classes, entropy, dictionary
coverage, path likeness, and neighbouring words. The dictionary is the table of letter trigrams counted
over all words of all documents (17,576 entries at most, whatever the corpus).

The forest learns from labelled findings: a table (left, candidate, right, label) of text before, the
string itself and text after, as reviewers save it (``read_findings``). Without one, ``example_findings`` makes
one by rule from public credential formats and their usual look-alikes (commit ids, digests, paths,
mails, placeholders, words in place of a value). At most ``most_findings`` rows are used, drawn by hash; that bound
is the parameter. The forest is some thousand numbers, broadcast to score whole texts in one Arrow pass, without a shuffle.

Edge cases: null and blank texts have no candidates; null ids are reported as null; repeated rows are
each reported; a table of findings with one label scores that label; an empty table gives an empty
result; extra columns are not read. Found strings are returned as digests, not in clear.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .wordhash import chunks

#: Words that name credentials, and words that name things which only look like them.
CREDENTIAL_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private_key", "client_secret", "session_key")
LOOKALIKE_WORDS = ("sha", "sha1", "sha256", "md5", "digest", "checksum", "commit", "hash", "etag", "uuid", "id", "revision", "build", "version", "integrity")
PLACEHOLDER = re.compile(r"example|placeholder|your[_-]|changeme|dummy|xxxx|test[_-]|sample|0{6}|1234567|\*{4}|\.{4}|\$\{|\$\(|%\(|\{\{|^<.*>$|\(\)$", re.I)
#: Words that stand in place of a value.
NO_VALUE = re.compile(r"(?:none|null|nil|true|false|required|optional|string|undefined|missing|invalid|expired|forgotten|hidden|redacted|unknown|default|empty|settings?|manager|generator|policy|field|reset|protected)[.,;]?", re.I)

_CANDIDATE = re.compile(r"[A-Za-z0-9_+/=.\-]{16,}")
_BLOCK = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----.*?-----END \1-----", re.S)
_SIGN = re.compile(r"=>|:=|[=:]")
_NAMED = re.compile(r"(?:" + "|".join(CREDENTIAL_WORDS) + r")[\"'`\]]?\s{0,3}$", re.I)
_VALUE = re.compile(r"\s{0,3}(?:\"([^\"\n]{6,200})\"|'([^'\n]{6,200})'|`([^`\n]{6,200})`|([^\s\"'`,;]{6,200}))")
_WORD = re.compile(r"[A-Za-z][A-Za-z0-9_\-]*")
_DIGIT = re.compile(r"[0-9]")
_CONTEXT = 48
FEATURES = (
    "length", "transitions", "digits", "uppers", "lowers", "marks", "distinct", "entropy", "hex", "coverage", "slashes", "dots", "extension", "host_left", "placeholder",
    "assigned", "quoted", "credential_last", "credential_near", "lookalike_near", "left_words", "right_word", "known_prefix", "all_digits", "blanks", "no_value", "private_block",
)
_PREFIX = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abp]-|sk_live_|sk-|rk_live_|eyJ|AIza|npm_|pypi-)")
_EXTENSION = re.compile(r"\.(?:js|css|html?|png|jpe?g|gif|svg|py|java|go|rs|json|xml|ya?ml|txt|md|zip|gz|jar|so|dll|com|org|net|io)\b", re.I)
_ASSIGN = re.compile(r"(?:[=:]|=>|:=)\s*[\"'`]?$")


@dataclass(frozen=True)
class SecretConfig:
    trees: int = 60
    depth: int = 8
    least_leaf: int = 4
    bins: int = 16
    most_findings: int = 6000
    dictionary_rate: float = 1e-4  # share of all letter trigrams from which one counts as known
    threshold: float = 0.5
    seed: int = 5


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of candidate strings, in order; of overlapping ones the widest."""
    found = [m.span() for m in _BLOCK.finditer(text)] if "-----BEGIN " in text else []
    at = 0
    while m := _SIGN.search(text, at):
        at = m.end()
        if _NAMED.search(text, max(0, m.start() - 24), m.start()) and (v := _VALUE.match(text, at)):
            a, b = v.span(v.lastindex)
            if v.lastindex == 4:
                b = a + len(text[a:b].rstrip(".)]}"))
            if b - a >= 6:
                found.append((a, b))
    for m in _CANDIDATE.finditer(text):
        s = m[0].strip("=.-") if m[0][0] in "=.-" else m[0].rstrip(".-")
        a = m.start() + m[0].find(s)
        if len(s) >= 16 and _DIGIT.search(s):
            found.append((a, a + len(s)))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
        elif b - a > out[-1][1] - out[-1][0]:
            out[-1] = (a, b)
    return out


def describe(left: str, s: str, right: str, known: frozenset[int]) -> list[float]:
    """The features of one finding, in the order of FEATURES."""
    n = len(s)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "m" for c in s]
    counts = {c: s.count(c) for c in set(s)}
    lower = s.lower()
    grams = [(ord(lower[i]) - 97) * 676 + (ord(lower[i + 1]) - 97) * 26 + ord(lower[i + 2]) - 97 for i in range(n - 2) if all("a" <= c <= "z" for c in lower[i : i + 3])]
    covered = set()
    at = 0
    for i in range(n - 2):
        if all("a" <= c <= "z" for c in lower[i : i + 3]):
            if grams[at] in known:
                covered |= {i, i + 1, i + 2}
            at += 1
    words = [w.lower() for w in _WORD.findall(left)][-4:]
    credential = lambda w: any(c in w for c in CREDENTIAL_WORDS)
    return [
        float(min(n, 200)), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1), kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n, kinds.count("m") / n,
        len(counts) / n, -sum(c / n * math.log2(c / n) for c in counts.values()), float(all(c in "0123456789abcdefABCDEF" for c in s)), len(covered) / n,
        float(s.count("/")), float(s.count(".")), float(bool(_EXTENSION.search(s))), float(left.endswith(("@", "/", ":/", "://", "\\")) or right.startswith("@")), float(bool(PLACEHOLDER.search(s))),
        float(bool(_ASSIGN.search(left))), float(left[-1:] in ("'", '"', "`") and right[:1] == left[-1:]), float(bool(words) and credential(words[-1])), float(any(map(credential, words))),
        float(any(w in LOOKALIKE_WORDS for w in words[-2:])), float(len(words)), float(bool(_WORD.match(right.lstrip("\"'` ,;.)")))), float(bool(_PREFIX.match(s))), float(s.isdigit()),
        float(s.count(" ")), float(bool(NO_VALUE.fullmatch(s.strip()))), float(s.startswith("-----BEGIN") and "PRIVATE KEY" in s[:60]),
    ]


def example_findings(n: int = 4000, seed: int = 17) -> list[tuple[str, str, str, int]]:
    """Labelled findings (left, candidate, right, label) by rule, half of them secrets."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexes, upper, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    b64 = alnum + "+/"
    syllables = "the an er on in ed re ing ti es or he al en tion ar de le que la ch ei st und ver ado os".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    case = lambda s: s.upper() if r.random() < 0.15 else s
    out: list[tuple[str, str, str, int]] = []
    for i in range(n):
        before, after = prose(r.randint(0, 6)), prose(r.randint(0, 4))
        q = r.choice(["", '"', "'", '"'])
        sep = r.choice([" = ", "=", ": ", ":", " => ", " := "])
        if i % 6 == 5:  # passwords: short, with marks
            s = pick(alnum + "!@#%^&*_-+?~", r.randint(8, 15)) if r.random() < 0.6 else r.choice([word, word, lambda: word().capitalize()])() + pick("0123456789", r.randint(1, 4)) + pick("!@#$%&*", r.randint(0, 2))
            s = s if len(s) >= 6 else s + pick(alnum, 6)
            if PLACEHOLDER.search(s) or s.isalpha():
                s = pick(alnum, 5) + "7k"
            out.append((case(f"{before} {r.choice(CREDENTIAL_WORDS)}{sep}{q}"), s, f"{q} {after}", 1))
            continue
        if i % 24 == 3:  # key blocks
            private = r.random() < 0.5
            kind = r.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY"]) if private else r.choice(["CERTIFICATE", "PUBLIC KEY", "RSA PUBLIC KEY", "CERTIFICATE REQUEST"])
            body = "\n".join(pick(b64, 64) for _ in range(r.randint(2, 12)))
            out.append((f"{before} ", f"-----BEGIN {kind}-----\n{body}\n-----END {kind}-----", f" {after}", int(private)))
            continue
        if i % 2:
            s = r.choice([lambda: pick(hexes, r.choice([32, 40, 64])), lambda: pick(hexes, 40), lambda: pick(b64, r.choice([24, 32, 40, 44])), lambda: "AKIA" + pick(upper, 16), lambda: "ghp_" + pick(alnum, 36), lambda: "sk_live_" + pick(alnum, 24), lambda: "eyJ" + pick(alnum, 30) + "." + pick(alnum, 40), lambda: pick(alnum + "_-", r.randint(18, 32))])()
            key = r.choice(CREDENTIAL_WORDS)
            left, right = f"{before} {key}{sep}{q}", f"{q} {after}"
            if r.random() < 0.1:
                left, right = f"{before} authorization bearer ", f" {after}"
            out.append((case(left), case(s) if r.random() < 0.1 else s, right, 1))
            continue
        kind = r.randrange(13)
        if kind == 0:
            left, s, right = f"{before} commit ", pick(hexes, 40), f" {after}"
        elif kind == 1:
            key, size = r.choice([("sha256", 64), ("sha1", 40), ("md5", 32), ("checksum", 40), ("etag", 32), ("integrity", 44), ("digest", 64)])
            left, s, right = f"{before} {key}{sep}{q}", pick(hexes, size), f"{q} {after}"
        elif kind == 2:
            h = pick(hexes, 32)
            left, s, right = f"{before} {r.choice(['id', 'uuid', 'request'])}{sep}{q}", f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", f"{q} {after}"
        elif kind == 3:
            left, s, right = f"{before} https://", f"{word()}.example.{r.choice(['com', 'org', 'net'])}/{word()}/{r.randint(1, 99999)}/{word()}", f" {after}"
        elif kind == 4:
            left, s, right = f"{before} {r.choice(['', '/usr', 'in '])}", f"/{word()}/{word()}/{word()}_{r.randint(1, 99)}.{r.choice(['py', 'js', 'html', 'txt'])}", f" {after}"
        elif kind == 5:
            left, s, right = r.choice([(f"{before} ", f"{word()}.{word()}.{r.randint(1, 999)}", f"@mail{r.randint(0, 9)}.example.com {after}"), (f"{before} {word()}.{r.randint(1, 99)}@", f"mail{r.randint(0, 9)}.example{r.randint(1, 9)}.com", f" {after}")])
        elif kind == 6:
            left, s, right = f"{before} ", pick("0123456789", r.randint(16, 19)), f" {after}"
        elif kind == 7:
            s = r.choice(["x" * r.randint(16, 40), "your_" + r.choice(["token", "password", "api_key"]) + "_here_123", "EXAMPLE_KEY_1234567890", "changeme_changeme_1", "0000000000000000000000", "test_token_placeholder1"])
            left, right = f"{before} {r.choice(CREDENTIAL_WORDS)}{sep}{q}", f"{q} {after}"
        elif kind in (10, 11):  # a word, or a sign of an absent value, after a credential word
            s = r.choice([lambda: word() + word(), lambda: r.choice(["required", "undefined", "missing", "optional", "string", "redacted", "invalid", "settings"]), lambda: "*" * r.randint(6, 12), lambda: "${" + word().upper() + "_TOKEN}", lambda: f"<{word()}-password>", lambda: f"get_{word()}()", lambda: prose(r.randint(2, 6))])()
            left, s, right = f"{before} {r.choice(CREDENTIAL_WORDS)}{sep}{q}", s if len(s) >= 6 else s + "tionen", f"{q} {after}"
        elif kind == 12:  # a number that nothing names
            left, s, right = f"{before} {word()} ", pick("0123456789", 16), f" {after}"
        elif kind == 8:
            left, s, right = f"{before} ", "-".join(word() for _ in range(4)) + str(r.randint(1, 2030)), f" {after}"
        else:
            left, s, right = f"{before} ", pick(hexes, r.choice([24, 32, 40])) if r.random() < 0.5 else "data/" + pick(b64, 60), f" {after}"
        out.append((case(left), s if len(s) >= 16 else s + "-" + word() * 4 + "1", right, 0))
    return out


# ---- the forest ----


def _split(x: np.ndarray, y: np.ndarray, columns: np.ndarray, cfg: SecretConfig):
    """(column, threshold) with the least Gini impurity, or None."""
    best, found = 1e18, None
    for c in columns:
        cuts = np.unique(np.quantile(x[:, c], np.linspace(0, 1, cfg.bins + 1)[1:-1]))
        for t in cuts:
            go = x[:, c] <= t
            n = int(go.sum())
            if n < cfg.least_leaf or len(y) - n < cfg.least_leaf:
                continue
            p, q = y[go].mean(), y[~go].mean()
            impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
            if impurity < best - 1e-12:
                best, found = impurity, (int(c), float(t))
    return found


def grow_tree(x: np.ndarray, y: np.ndarray, cfg: SecretConfig, rng: np.random.Generator) -> np.ndarray:
    """Rows (column or -1, threshold, left child, right child, value)."""
    rows: list[list[float]] = []

    def node(at: np.ndarray, depth: int) -> int:
        me = len(rows)
        rows.append([-1, 0.0, 0, 0, float(y[at].mean()) if len(at) else 0.5])
        if depth < cfg.depth and len(at) >= 2 * cfg.least_leaf and 0 < y[at].sum() < len(at):
            columns = rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1])) + 1), replace=False)
            cut = _split(x[at], y[at], columns, cfg)
            if cut:
                go = x[at, cut[0]] <= cut[1]
                rows[me][:2] = cut
                rows[me][2] = node(at[go], depth + 1)
                rows[me][3] = node(at[~go], depth + 1)
        return me

    node(rng.integers(0, len(y), len(y)), 0)
    return np.array(rows)


def fit_forest(x: np.ndarray, y: np.ndarray, cfg: SecretConfig = SecretConfig()) -> list[np.ndarray]:
    rng = np.random.default_rng(cfg.seed)
    return [grow_tree(x, y.astype(float), cfg, rng) for _ in range(cfg.trees)] if len(y) else []


def forest_score(x: np.ndarray, forest: list[np.ndarray]) -> np.ndarray:
    total = np.zeros(len(x))
    for tree in forest:
        at = np.zeros(len(x), np.int64)
        while True:
            column = tree[at, 0].astype(np.int64)
            inner = column >= 0
            if not inner.any():
                break
            go = x[np.arange(len(x)), np.maximum(column, 0)] <= tree[at, 1]
            at = np.where(inner, np.where(go, tree[at, 2], tree[at, 3]).astype(np.int64), at)
        total += tree[at, 4]
    return total / max(1, len(forest))


# ---- over documents ----


def _trigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(26**3, np.int64)
    for batch in batches:
        for c in chunks(batch.column("text"), lower=True):
            d = c.data.astype(np.int64) - 97
            ok = (d >= 0) & (d < 26)
            if len(d) > 2:
                cross = np.zeros(len(d), bool)  # trigrams that run over a row's end
                for k in (1, 2):
                    cross[np.maximum(c.offsets[1:-1] - k, 0)] = True
                three = ok[:-2] & ok[1:-1] & ok[2:] & ~cross[:-2]
                counts += np.bincount((d[:-2] * 676 + d[1:-1] * 26 + d[2:])[three], minlength=26**3)
    at = np.nonzero(counts)[0]
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["gram", "n"])


def dictionary(docs: DataFrame, cfg: SecretConfig = SecretConfig(), text_col: str = "text") -> frozenset[int]:
    """The letter trigrams that make up at least ``dictionary_rate`` of all, counted over all documents."""
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_trigram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counted.collect()  # 17,576 rows at most
    total = sum(r.n for r in rows)
    return frozenset(r.gram for r in rows if r.n >= cfg.dictionary_rate * total)


def train(findings: list[tuple[str, str, str, int]], known: frozenset[int], cfg: SecretConfig = SecretConfig()) -> list[np.ndarray]:
    """The forest over at most ``most_findings`` labelled findings."""
    drawn = sorted(findings, key=lambda f: hashlib.sha256("\0".join(map(str, f)).encode("utf-8", "replace")).digest())[: cfg.most_findings]
    x = np.array([describe(a[-_CONTEXT:], s, b[:_CONTEXT], known) for a, s, b, _ in drawn])
    return fit_forest(x, np.array([f[3] for f in drawn]), cfg)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed findings (left, candidate, right, label) from a folder of JSON lines or of Parquet (``*.parquet``)."""
    schema = "left string, candidate string, right string, label int"
    return spark.read.schema(schema).parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(schema).json(path)


def _scan(batches: Iterator[pa.RecordBatch], shared, cfg: SecretConfig) -> Iterator[pa.RecordBatch]:
    known, forest = shared.value
    for batch in batches:
        ids, starts, sizes, digests, rows = [], [], [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for a, b in candidates(text or ""):
                ids.append(doc_id)
                starts.append(a)
                sizes.append(b - a)
                digests.append(hashlib.sha256(text[a:b].encode("utf-8", "surrogatepass")).hexdigest())
                rows.append(describe(text[max(0, a - _CONTEXT) : a], text[a:b], text[b : b + _CONTEXT], known))
        score = forest_score(np.array(rows), forest) if rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(score, pa.float64()), pa.array(score >= cfg.threshold)], ["doc_id", "start", "length", "secret_sha256", "score", "is_secret"])


def scan(docs: DataFrame, findings: list[tuple[str, str, str, int]] | DataFrame | None = None, cfg: SecretConfig = SecretConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per candidate: doc_id, start and length in code points, secret_sha256, score, is_secret."""
    known = dictionary(docs, cfg, text_col)
    if isinstance(findings, DataFrame):
        bounded = findings.orderBy(F.xxhash64("left", "candidate", "right", "label")).limit(cfg.most_findings)
        findings = [(r.left or "", r.candidate, r.right or "", r.label) for r in bounded.where("candidate IS NOT NULL AND label IS NOT NULL").collect()]
    forest = train(example_findings() if findings is None else findings, known, cfg)
    shared = docs.sparkSession.sparkContext.broadcast((known, forest))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(lambda it: _scan(it, shared, cfg), "doc_id long, start long, length long, secret_sha256 string, score double, is_secret boolean")
