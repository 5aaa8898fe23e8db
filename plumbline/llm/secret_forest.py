"""Secret scan whose false positives a random forest removes.

A pattern proposes candidates: known key formats, assigned values, and long runs of key characters that hold a digit. Each
candidate is described by its length, character classes, character transitions (mean log-probability under the
transitions of ordinary words), dictionary coverage, the path it stands in and its neighbouring words; a forest of gini trees grown by
numpy on labelled findings decides. labelled_findings() writes such findings; train() takes any.

Texts are scanned whole, one by one, so a task's memory is that of its longest text.

Defined cases: null and empty texts have no findings; of overlapping candidates that the forest keeps one is the finding (known formats
before assigned values before runs, then the earliest, then the longest); a document with many findings has a row for each; a row
without doc_id is scanned like any other; repeated rows are each scanned; other columns, of whatever name, are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import math
import random
import re
import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import begin, table

# fixed values: public formats of keys
FORMATS = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|sk_(?:live|test)_[0-9a-zA-Z]{16,}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]*PRIVATE KEY-----"
ASSIGNED = r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|credential)s?[\"']?\s{0,3}(?::=|=>|=|:)\s{0,3}[\"']?(?P<value>[^\s\"',;<>&]{6,})"
RUN = r"[A-Za-z0-9+/_.-]{16,}={0,2}"
ORDER = ("format", "assigned", "run")  # of candidates that overlap, the first kind that the forest keeps is the finding
_RUN, _FORMAT, _ASSIGNED = re.compile(RUN), re.compile(FORMATS), re.compile(ASSIGNED)
_HINT = re.compile(r"(?i)pass|pwd|secret|token|key|auth|credential")
KEY_WORDS = set("password passwd pwd secret token key apikey api_key access_key auth authorization bearer credential credentials private client_secret".split())
OTHER_WORDS = set("commit sha sha1 sha256 md5 checksum hash digest uuid guid id isbn card phone tel version revision build order invoice serial etag integrity example sample dummy test placeholder fake mock href src url http https".split())
SAFE_PATHS = set("test tests example examples sample samples fixture fixtures mock mocks doc docs lock vendor".split())
RISKY_PATHS = set("env cfg conf config ini properties pem key yml yaml tf credentials secrets settings".split())
COMMON = (
    "the and for that with this from have are was not you all can had her one our out has his how its may new now old see two way who did get let say she too use "
    "admin user name value string data file path test example sample your here change config server client service public private default value index table image style class content section header footer button color background "
    "password secret token access key account email address number version update release project system network module package license"
).split()

TREES, DEPTH, LEAST = 40, 10, 3
CUT = 0.5


def candidates(text: str):
    """(start, end, kind) of all that may be a secret. Candidates of different kinds may overlap; each is judged for itself."""
    found = []
    for m in _RUN.finditer(text):
        run = m[0].rstrip(".-/")
        if any(c.isdigit() for c in run) and len(run) >= 16:
            found.append((m.start(), m.start() + len(run), "run"))
    if "-----BEGIN" in text or "AKIA" in text or "_" in text or "-" in text or "eyJ" in text or "AIza" in text:
        found += [(m.start(), m.end(), "format") for m in _FORMAT.finditer(text)]
    if _HINT.search(text):
        found += [(*m.span("value"), "assigned") for m in _ASSIGNED.finditer(text)]
    return found


def apart(found: list[tuple]) -> list[tuple]:
    """Of findings (start, end, kind, ...) those that stand when overlaps are resolved: by ORDER of kinds, then the earliest, then the longest."""
    out, starts, ends = [], [], []
    for f in sorted(found, key=lambda f: (ORDER.index(f[2]), f[0], -f[1])):
        k = bisect.bisect_right(starts, f[0])
        if (k and ends[k - 1] > f[0]) or (k < len(starts) and starts[k] < f[1]):
            continue
        starts.insert(k, f[0])
        ends.insert(k, f[1])
        out.append(f)
    return sorted(out)


def _transitions() -> np.ndarray:
    """Log-probabilities of a character after another, in ordinary words."""
    counts = np.ones((128, 128))
    for w in COMMON:
        for a, b in zip(w, w[1:], strict=False):
            counts[ord(a), ord(b)] += 4
    for a in string.ascii_lowercase:
        for v in "aeiou":
            counts[ord(a), ord(v)] += 6
            counts[ord(v), ord(a)] += 3
    return np.log(counts / counts.sum(axis=1, keepdims=True))


_FLOW = _transitions()
_LONG_WORDS = re.compile("|".join(sorted({w for w in COMMON if len(w) > 2}, key=len, reverse=True)))
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_WORD = re.compile(r"[A-Za-z_]+")


def describe(text: str, start: int, end: int, kind: str, path: str = "") -> list[float]:
    value = text[start:end]
    n = len(value)
    codes = np.frombuffer(value.encode("ascii", "replace"), np.uint8)
    digit, lower, upper = (codes >= 48) & (codes <= 57), (codes >= 97) & (codes <= 122), (codes >= 65) & (codes <= 90)
    group = digit * 1 + lower * 2 + upper * 3
    hexa = digit | ((codes | 32) >= 97) & ((codes | 32) <= 102)
    _, counts = np.unique(codes, return_counts=True)
    p = counts / n
    low = codes | (32 * upper).astype(np.uint8)
    flow = float(_FLOW[low[:-1] & 127, low[1:] & 127].mean()) if n > 1 else 0.0
    known = sum(len(m[0]) for m in _LONG_WORDS.finditer(value.lower()))
    before, after = text[max(0, start - 48) : start], text[end : end + 24]
    words = [w.lower() for w in _WORD.findall(before)][-3:]
    near = {x for w in words for x in (w, *w.split("_"))}
    parts = set(re.split(r"[/._\\-]", path.lower()))
    joint = before.rstrip()[-1:] if before.rstrip() else ""
    quote = before[-1:] in "\"'" and before != ""
    bare = before.rstrip("\"' ")[-1:]
    return [
        n, math.log(n), digit.mean(), lower.mean(), upper.mean(), 1 - (digit | lower | upper).mean(), float(hexa.mean()), float(-(p * np.log2(p)).sum()), float((group[1:] != group[:-1]).mean()) if n > 1 else 0.0,
        flow, known / n, float(len(counts) / n), float(digit.all()), float(hexa.all()), float(bool(_UUID.fullmatch(value))), float(n in (32, 40, 56, 64, 128)), float(value.count(".") + value.count("/")), float(value.count("-")), float(value.count("_")), float("=" in value[:-2]),
        float(bool(near & KEY_WORDS)), float(bool(near & OTHER_WORDS)), float(quote), float(bare in ("=", ":")), float(joint == "/" or after[:1] in "/@"), float(after[:1] in "\"'"), float(kind == "format"), float(kind == "assigned"),
        float(bool(parts & SAFE_PATHS)), float(bool(parts & RISKY_PATHS)), float(bool(re.search(r"(?i)your|example|x{4,}|\*{3,}|changeme|<|\$\{|0{6,}|1234", value))), float(_luhn(value)),
    ]


def _luhn(value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit()]
    return len(digits) == len(value.replace("-", "")) and len(digits) >= 12 and sum(d if k % 2 == 0 else (2 * d - 9 * (d > 4)) for k, d in enumerate(reversed(digits))) % 10 == 0


# --- forest -----------------------------------------------------------------------------------------------------------


@dataclass
class Forest:
    """Trees in arrays: a node's feature (-1: leaf), limit, children and share of secrets."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray
    roots: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        while True:
            f = self.feature[at]
            if (f < 0).all():
                return self.share[at].mean(axis=1)
            go_left = x[rows, np.maximum(f, 0)] <= self.limit[at]
            at = np.where(f < 0, at, np.where(go_left, self.left[at], self.right[at]))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 3) -> Forest:
    """Bootstrap rows for each tree, a random root-sized set of features for each split, gini impurity."""
    rng = np.random.default_rng(seed)
    feature, limit, left, right, share, roots = [], [], [], [], [], []
    m = max(1, round(math.sqrt(x.shape[1])))

    def node(rows: np.ndarray, depth: int) -> int:
        k = len(feature)
        feature.append(-1)
        limit.append(0.0)
        left.append(k)
        right.append(k)
        share.append(float(y[rows].mean()))
        if depth == 0 or len(rows) < 2 * LEAST or share[k] in (0.0, 1.0):
            return k
        best = (1e-9, -1, 0.0)
        n, ones = len(rows), y[rows].sum()
        whole = 2 * ones * (n - ones) / n
        for f in rng.choice(x.shape[1], m, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, one = x[order, f], np.cumsum(y[order])[:-1]
            size = np.arange(1, n)
            gain = whole - 2 * one * (size - one) / size - 2 * (ones - one) * (n - size - (ones - one)) / (n - size)
            gain[(v[1:] == v[:-1]) | (size < LEAST) | (n - size < LEAST)] = -1
            if len(gain) and gain.max() > best[0]:
                b = int(gain.argmax())
                best = (float(gain[b]), int(f), float((v[b] + v[b + 1]) / 2))
        if best[1] >= 0:
            feature[k], limit[k] = best[1], best[2]
            low = x[rows, best[1]] <= best[2]
            left[k] = node(rows[low], depth - 1)
            right[k] = node(rows[~low], depth - 1)
        return k

    for _ in range(trees):
        roots.append(node(rng.integers(0, len(y), len(y)), DEPTH))
    return Forest(np.array(feature), np.array(limit), np.array(left), np.array(right), np.array(share), np.array(roots))


def train(findings: list[tuple[str, int, int, str, str, int]]) -> Forest:
    """findings: text, start, end, kind, path, label (1: a secret)."""
    x = np.array([describe(t, a, b, k, p) for t, a, b, k, p, _ in findings])
    return grow(x, np.array([f[-1] for f in findings], dtype=float))


# --- labelled findings --------------------------------------------------------------------------------------------------


def labelled_findings(n: int = 3000, seed: int = 5) -> list[tuple[str, int, int, str, str, int]]:
    """Texts with a secret or with what looks like one, as the scan proposes them."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        label = int(rng.random() < 0.5)
        value, before, after, path = _secret(rng) if label else _lookalike(rng)
        text = _filler(rng) + before + value + after + _filler(rng)
        at = text.find(before + value) + len(before)
        for a, b, kind in candidates(text):
            if (a, b) == (at, at + len(value)) if label else a < at + len(value) and b > at:
                out.append((text, a, b, kind, path, label))
    return out


def _chars(rng, alphabet: str, n: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(n))


def _filler(rng) -> str:
    words = ["".join(rng.choice(["an", "the", "er", "ion", "ou", "re", "sch", "ción", "eau", "ti", "st"]) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 9))]
    return " ".join(words).join(rng.choice([(" ", " "), ("", " "), (" ", "\n")]))


_B64, _HEX, _ALNUM = string.ascii_letters + string.digits + "+/", "0123456789abcdef", string.ascii_letters + string.digits


def _secret(rng) -> tuple[str, str, str, str]:
    name = rng.choice("token secret password api_key API_KEY apiKey auth_token SECRET_KEY access_key client_secret passwd private_key bearer_token db_password".split())
    q = rng.choice(['"', "'", ""])
    before = rng.choice([f"{name} = {q}", f"{name}={q}", f"{name}: {q}", f'"{name}": "', f"--{name}={q}", "Authorization: Bearer ", f"export {name.upper()}={q}"])
    value = rng.choice(
        [
            lambda: _chars(rng, _HEX, rng.choice([32, 40, 40, 48, 64])), lambda: _chars(rng, _ALNUM, rng.randint(20, 48)), lambda: _chars(rng, _B64, rng.choice([40, 43, 64])) + rng.choice(["", "="]),
            lambda: "AKIA" + _chars(rng, string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + _chars(rng, _ALNUM, 36), lambda: "sk_live_" + _chars(rng, _ALNUM, 24), lambda: "sk-" + _chars(rng, _ALNUM, 40),
            lambda: "xoxb-" + _chars(rng, string.digits, 11) + "-" + _chars(rng, _ALNUM, 24), lambda: "AIza" + _chars(rng, _ALNUM + "_-", 35), lambda: _chars(rng, _ALNUM + "!@#%^*", rng.randint(9, 16)),
            lambda: "eyJ" + _chars(rng, _ALNUM, 20) + ".eyJ" + _chars(rng, _ALNUM, 40) + "." + _chars(rng, _ALNUM + "_-", 43),
        ]
    )()
    if value[:4] in ("AKIA", "ghp_", "sk_l", "xoxb", "AIza") and rng.random() < 0.4:
        before, q = rng.choice([" ", "", "("]), ""
    return value, before, q if q and before.endswith(q) else rng.choice(["", "\n", " "]), rng.choice(["", "", "src0", ".env", "config/app.yml", "deploy/settings.ini", "main.tf"])


def _lookalike(rng) -> tuple[str, str, str, str]:
    kind = rng.randrange(13)
    path = rng.choice(["", "", "src1", "docs/readme.md", "tests/test_app.py", "package-lock.json", "examples/a.txt"])
    word = lambda: "".join(rng.choice(["an", "the", "er", "ion", "ou", "re", "ver", "sch", "data", "user", "page"]) for _ in range(rng.randint(1, 4)))
    if kind == 0:
        return _chars(rng, _HEX, 40), rng.choice(["commit ", "sha1: ", "rev ", "Revision: ", "at "]), rng.choice(["", "\n"]), path
    if kind == 1:
        h = lambda k: _chars(rng, _HEX, k)
        return f"{h(8)}-{h(4)}-{h(4)}-{h(4)}-{h(12)}", rng.choice(["id: ", "uuid=", "", "request "]), "", path
    if kind == 2:
        return _chars(rng, string.digits, rng.choice([16, 16, 18, 20])), rng.choice(["card ", "", "order ", "the ", "nt ", "account number "]), "", path
    if kind == 3:
        return "/".join([word() for _ in range(rng.randint(2, 5))]) + f"/{rng.randint(1, 9999)}.html", rng.choice(["https://www.example.com/", "/", "href="]), "", path
    if kind == 4:
        return f"{word()}{rng.randint(1, 99)}.{word()}.example.com", rng.choice(["", "mail@", "http://"]), "", path
    if kind == 5:
        return rng.choice(["your_api_key_here_123", "xxxxxxxxxxxxxxxx1", "changeme123", "<YOUR-TOKEN-1>", "${SECRET_TOKEN_1}", "example-password-1", "0000000000000000", "1234567890123456", "your-secret-goes-here"]), rng.choice(["password = ", "token: ", 'api_key = "', "secret="]), "", path
    if kind == 6:
        return _chars(rng, _HEX, rng.choice([32, 64])), rng.choice(["md5: ", "sha256:", "checksum ", "etag ", "integrity: sha256-", "digest="]), "", path
    if kind == 7:
        return f"{word()}_{word()}_{word()}_{rng.randint(1, 9)}", rng.choice(["", "def ", "class ", "var "]), rng.choice(["", "(", "="]), path
    if kind == 8:
        return f"20{rng.randint(10, 29)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}.{rng.randint(10, 59)}.00", rng.choice(["date ", "", "at "]), "Z", path
    if kind == 9:
        return "-".join(_chars(rng, string.digits, k) for k in (3, 4, 5, 4)), rng.choice(["tel ", "phone: ", "ISBN ", ""]), "", path
    if kind == 10:
        return word() + word() + rng.choice([".length", ".value", "_field", ""]), rng.choice(["password: ", "token = ", "secret=", "auth: "]), rng.choice(["", ";"]), path
    if kind == 11:
        return "-".join(word() for _ in range(4)) + f"-v{rng.randint(1, 9)}.{rng.randint(0, 9)}", rng.choice(["", "build ", "id="]), "", path
    return _chars(rng, _B64, rng.randint(60, 120)), rng.choice(["data:image/png;base64,", "integrity=\"sha512-", "src=\"data:font/woff;base64,"]), "", path


@functools.cache
def default_forest() -> Forest:
    return train(labelled_findings())


# --- Spark ----------------------------------------------------------------------------------------------------------


def scan(docs: DataFrame, forest: Forest | None = None, path: str | None = "source", cut: float = CUT) -> DataFrame:
    """docs(doc_id, text, path) -> doc_id, start, end (characters), kind, score of each finding that the forest keeps."""
    forest = forest or default_forest()
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "start", "end", "kind", "score"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
        begin("secret forest")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts, paths = (batch.column(k).slice(at, 256).to_pylist() for k in range(3))
                rows, x = [], []
                for at_row, (t, p) in enumerate(zip(texts, paths, strict=True)):
                    for a, b, kind in candidates(t or ""):
                        rows.append((at_row, a, b, kind))
                        x.append(describe(t, a, b, kind, p))
                if not rows:
                    continue
                good: dict[int, list] = {}
                for (r, *f), s in zip(rows, forest.scores(np.array(x)), strict=True):
                    if s >= cut:
                        good.setdefault(r, []).append((*f, float(s)))
                kept = [(ids[r], *f) for r, found in good.items() for f in apart(found)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*kept, strict=True), kinds, strict=True)] if kept else [pa.array([], k) for k in kinds], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), where.alias("path")).mapInArrow(run, "doc_id long, start long, end long, kind string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
