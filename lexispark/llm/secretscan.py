"""Secret scans: candidates by pattern, judged by a random forest; DataFrame operations only.

A candidate is a private key from its header to its end line; the value behind a name with a key word, of 4 characters or
more and with or without digits (quoted values may hold spaces; without a sign between, 6 or more and a digit); or a run
of 16 or more token characters that holds a digit or has a key word beside it. Runs are split at '=' signs that are not
padding, unless no part is a candidate by itself. Features: length, shares of character classes, character transitions,
distinct characters, dictionary coverage, words on both sides of the candidate and words of the path (the document's
source). The forest learns from labelled findings: rows of (path, before, candidate, label) and, where known, after. The
default ones are made by rule from public formats of keys and of harmless look-alikes
(commit ids, checksums, UUIDs, card and serial numbers, mail addresses, URLs, identifiers, placeholders).
"""

from __future__ import annotations

import json
import random

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fits_broadcast, with_key, written

BEFORE = 48
AFTER = 48
MASK = "[SECRET]"
ASSIGNED = "(?:[=:]>?\\s*\\\\?[\"'`]?|[=:]\\s*(?:bearer|basic|token)\\s+|\\s(?:is|was)\\s+[\"'`]?)$"
N_EXAMPLES = 4000

# words that tell names and prose from random strings
DICTIONARY = ["account", "admin", "backup", "branch", "build", "cache", "class", "client", "commit", "config", "controller", "data", "default", "demo", "domain", "error", "example", "file", "final", "handler", "http", "image", "index", "info", "invoice", "item", "local", "mail", "main", "manager", "message", "model", "module", "number", "object", "order", "page", "path", "product", "project", "report", "request", "response", "sample", "serial", "server", "service", "session", "site", "source", "static", "system", "table", "test", "time", "update", "user", "value", "version", "view", "window", "work", "your"]
KEY_WORDS = "token|secret|passw|passphrase|pwd|api[_ -]?key|access[_ -]?key|auth(?!ors?\\b)|bearer|private|credential|client[_ -]?key"
PLAIN_WORDS = "commit|checksum|sha1|sha256|md5|digest|hash|uuid|guid|build|revision|etag|serial|invoice|order|card|phone|mail|http|href|src|version|ticket|isbn"
PATH_WORDS = "test|example|sample|doc|lock|fixture|mock"
FEATURES = ["f_length", "f_digit", "f_upper", "f_lower", "f_hex", "f_other", "f_transitions", "f_distinct", "f_dictionary", "f_vowels", "f_mail", "f_header", "f_key_word", "f_plain_word", "f_assigned", "f_path", "f_key_after", "f_plain_after", "f_placeholder"]
# values that stand for a secret or describe it
PLACEHOLDER = r"^(?:null|none|nil|true|false|str|string|text|bytes|int|bool|optional|any|required|undefined|changeme|redacted|removed|hidden|masked|empty|missing|invalid|valid|expired|disabled|enabled|not|the|that|this|these|used|sent|stored|needed|wrong|about|with|from|your|you|self|input|value|default|todo|tbd)\b|^(?:your|my|some|example|sample|dummy|fake|test)[_. -]|x{6,}|\*{4,}|^[$%{<\[]|environ|getenv|process\.env|^[A-Za-z_.]+\($|(?:config|settings|args|options|self|request|response|params)\."

_END = r"-----END [A-Z0-9 ]{0,24}PRIVATE KEY(?: BLOCK)?-----"
HEADER = r"-----BEGIN [A-Z0-9 ]{0,24}PRIVATE KEY(?: BLOCK)?-----(?:[^-]{1,16384}+(?:-[^-]{1,16384}+){0,64}+" + _END + r"|(?:(?:\s|\\[nr]){1,8}+[A-Za-z0-9+/=]{32,}+){1,400}+)?+"
NAME = rf"[A-Za-z0-9_+/=~.@\-]{{0,128}}?(?i:{KEY_WORDS})[A-Za-z0-9_\-]{{0,40}}+(?i:[ _-]keys?)?+"
LEAD = NAME + r"(?:[\\\"'`\])]{0,3}\s{0,3}(?::=|=>|={1,3}|:)\s{0,3}|\s{1,3}(?i:is|was)(?:\s{0,3}:)?\s{1,3})(?i:(?:bearer|basic|token)\s{1,3})?"
QUOTE = r"\\?[\"'`]?"
PLAIN = r"[^\s\"'`<>,;&(){}\[\]]"
VALUE = rf"""(?!{QUOTE}-----BEGIN)(?:\\?"[^"\r\n]{{4,256}}+"|\\?'[^'\r\n]{{4,256}}+'|{QUOTE}{PLAIN}{{4,}}+)"""
SPACED = rf"{QUOTE}[^\s\"'`0-9<>,;&(){{}}\[\]]{{0,64}}+[0-9]{PLAIN}*+"
HAS_KEY_WORD = f"(?i)(?=[abcpst])(?:{KEY_WORDS})"
RUN = r"[A-Za-z0-9_+/=~.@\-]{16,}+"
CANDIDATE = rf"{HEADER}|{LEAD}{VALUE}|{NAME}\s{{1,3}}{SPACED}|(?:(?!-----BEGIN)[A-Za-z0-9_+/=~.@\-]){{16,}}+"


def labelled_findings(n: int = N_EXAMPLES, seed: int = 9) -> list[dict]:
    """n findings made by rule: kinds of keys (label 1) and of look-alikes (label 0) in the contexts they occur in."""
    r = random.Random(seed)
    hexa, alnum, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    s = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    prose = lambda: " ".join(s(letters[: r.randint(8, 26)], r.randint(2, 9)) for _ in range(r.randint(0, 5)))
    names = ["token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "AUTH", "client_secret", "private_key", "API-KEY", "Bearer", "credential", "db_passwd"]
    word = lambda: r.choice(DICTIONARY)
    upper, lower, marks = alnum[:26], alnum[26:52], "!@#%^*_+-.?"
    block = lambda kind: f"-----BEGIN {kind}PRIVATE KEY-----\n" + "\n".join(s(b64, 64) for _ in range(r.randint(2, 26))) + f"\n-----END {kind}PRIVATE KEY-----"
    # what stands behind a candidate says something of it by a key word or a plain word
    says_key = lambda: r.choice([" is the {}", " # {}", " ({})", "\" // {}", " as {}", "' -- my {}"]).format(r.choice(["api token", "password", "secret", "auth token", "access key", "credential"]))
    says_plain = lambda: r.choice([" is the {}", " # {}", " ({})", "\" // {}", " as {}"]).format(r.choice(["commit", "sha256 checksum", "md5", "order number", "build", "uuid"]))
    out = []
    for _ in range(n):
        joined = r.choice([" = \"", "=\"", ": \"", " = '", "=", ": ", " := \"", " "])
        name = r.choice(names)
        name = r.choice([name, name, f"{word()}_{name}", f"{word()}_{name}".upper(), f'"{name}"' if joined[0] in ":=" else name])
        keyed = f"{prose()} {name}{joined}"
        signed = keyed if joined != " " else f"{prose()} {name} is "
        behind = r.choice(["", "\"", "'", "\" ", " ", ", ", ";"]) + prose() + r.choice(["", "", f" {r.choice(names)}={s(hexa, 20)}"])
        secret = [
            lambda: (keyed, s(hexa, r.choice([32, 40, 48, 64]))), lambda: (keyed, s(hexa, r.choice([32, 40, 64]))), lambda: (keyed, s(alnum, r.randint(20, 60))),
            lambda: (keyed, s(b64, r.randint(20, 60)) + "=" * r.randint(0, 2)), lambda: (r.choice([keyed, prose() + " "]), "AKIA" + s(alnum[:26] + "234567", 16)),
            lambda: (r.choice([keyed, prose() + " "]), "ghp_" + s(alnum, 36)), lambda: (r.choice([keyed, prose() + " "]), f"xoxb-{s('0123456789', 12)}-{s(alnum, 24)}"),
            lambda: (keyed, f"eyJ{s(alnum, 30)}.eyJ{s(alnum, 60)}.{s(alnum, 43)}"), lambda: (r.choice([keyed, prose() + " "]), f"sk_live_{s(alnum, 24)}"),
            lambda: (prose() + " ", f"-----BEGIN {r.choice(['RSA ', 'EC ', 'OPENSSH ', ''])}PRIVATE KEY-----"), lambda: (prose() + " ", block(r.choice(["RSA ", "EC ", "OPENSSH ", ""]))),
            lambda: (signed, s(alnum, r.randint(6, 16))), lambda: (signed, s(upper + lower, r.randint(8, 40))), lambda: (signed, s(lower, r.randint(7, 24))),
            lambda: (signed, s(lower, r.randint(3, 8)) + s("0123456789", r.randint(1, 4)) + r.choice(["", r.choice(marks)])), lambda: (signed, s(alnum + marks, r.randint(6, 20))),
            lambda: (f"{prose()} {name} = \"", " ".join(s(letters[:20], r.randint(3, 8)) for _ in range(r.randint(3, 6)))),
            lambda: (f"{prose()} {r.choice(['', '\"', '= '])}", s(r.choice([hexa, alnum]), r.choice([20, 32, 40])), says_key()),
        ]
        plain = [
            lambda: (f"{prose()} {r.choice(['commit', 'revision', 'Revert', 'sha1:', 'md5', 'checksum', 'sha256:', 'etag ', 'build', 'digest ='])} ", s(hexa, r.choice([16, 32, 40, 64]))),
            lambda: (f"{prose()} {r.choice(['uuid', 'id', 'guid:', 'ref', ''])} ", "-".join(s(hexa, k) for k in (8, 4, 4, 4, 12))),
            lambda: (f"{prose()} ", s("0123456789", r.randint(16, 20))), lambda: (f"{prose()} {r.choice(['card', 'serial', 'order', 'invoice no', 'ISBN', ''])} ", s("0123456789", r.randint(16, 22))),
            lambda: (f"{prose()} ", f"{s(letters[:20], r.randint(3, 9))}.{s('0123456789', 2)}@mail{r.randint(0, 9)}.example.com"),
            lambda: (f"{prose()} ", f"{word()}.{word()}{r.randint(0, 99)}@{word()}.org"), lambda: (f"{prose()} {r.choice(['http:', 'href=', 'https:', 'src='])}", f"//www.{word()}.com/{word()}/{word()}-{r.randint(1, 999)}.html"),
            lambda: (f"{prose()} ", f"{word()}_{word()}_{word()}_{r.randint(0, 999)}"), lambda: (f"{prose()} ", f"/usr/local/{word()}/{word()}/{word()}{r.randint(1, 9)}.py"),
            lambda: (keyed, f"{r.choice(['your', 'example', 'sample', 'test'])}_{word()}_{r.choice(['token', 'key', 'here'])}_{r.randint(1, 1234)}"), lambda: (keyed, "x" * r.randint(16, 40) + "1"),
            lambda: (f"{prose()} ", f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}.{r.randint(10, 59)}.{r.randint(10, 59)}Z"),
            lambda: (f"{prose()} ", f"{s(letters[:22], r.randint(6, 14))}{r.choice('-_.')}{s(letters[:22], r.randint(6, 14))}{r.randint(0, 99)}"),
            lambda: (signed, r.choice(["null", "None", "true", "false", "string", "required", "undefined", "changeme", "expired", "invalid", "that", "this", "used", "missing", "stored", "input", "default", "self.value", "os.environ", "process.env.NAME", "config.get", "${NAME}", "********", "xxxxxxxx", "your-password", "<password>"])),
            lambda: (signed, f"{r.choice(['get', 'load', 'read', 'new', 'the', 'user', 'request'])}{r.choice('_.')}{word()}"), lambda: (signed, word()), lambda: (f"{prose()} ", f"{word()}_{word()}{r.randint(1, 9)}_{r.choice(names)}", f"={s(alnum, 24)}"),
            lambda: (f"{prose()} ", s(hexa, r.choice([16, 32, 40, 64])), says_plain()), lambda: (f"{prose()} ", s(hexa, r.choice([32, 40]))),
        ]
        label = int(r.random() < 0.5)
        before, candidate, *after = r.choice(secret if label else plain)()
        path = r.choice(["src{}", "lib/{}.py", "{}", "docs/{}.md", "test/{}.js", "conf/{}.yml"]).format(r.randint(0, 40))
        out.append({"path": path, "before": before[-BEFORE:], "candidate": candidate, "after": (after[0] if after else behind)[:AFTER], "label": label})
    return out


def with_features(df: DataFrame) -> DataFrame:
    """Adds FEATURES, doubles between 0 and 1 but for the length, to (path, before, candidate) and, where there is one, after."""
    c, low = F.col("candidate"), F.lower("candidate")
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    share = lambda pattern, of=c: F.regexp_count(of, F.lit(pattern)) / n
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]", "-"), "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    runs = F.length(F.regexp_replace(classes, r"(.)\1++", "$1"))
    near = F.lower(F.coalesce("before", F.lit("")))
    # up to the line's end or the next name that a value is given to: that name's words are the next value's
    far = F.regexp_replace(F.lower(F.coalesce("after", F.lit("")) if "after" in df.columns else F.lit("")), r"(?s)[\r\n].*|\S*\s*[=:].*", "")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return df.withColumns({
        "f_length": F.length(c).cast("double"), "f_digit": share("[0-9]"), "f_upper": share("[A-Z]"), "f_lower": share("[a-z]"), "f_hex": share("[0-9a-f]"), "f_other": share("[^A-Za-z0-9]"),
        "f_transitions": (runs - 1) / n, "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "f_dictionary": F.lit(1.0) - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / n, "f_vowels": share("[aeiou]", low), "f_mail": flag(F.contains(c, F.lit("@"))), "f_header": flag(F.startswith(c, F.lit("-----BEGIN"))),
        "f_key_word": flag(near.rlike(KEY_WORDS)), "f_plain_word": flag(near.rlike(PLAIN_WORDS)), "f_assigned": flag(near.rlike(ASSIGNED)), "f_path": flag(F.lower("path").rlike(PATH_WORDS)),
        "f_key_after": flag(far.rlike(KEY_WORDS)), "f_plain_after": flag(far.rlike(PLAIN_WORDS)), "f_placeholder": flag(low.rlike(f"(?i){PLACEHOLDER}")),
    })


def trained(findings: DataFrame, trees: int = 40, depth: int = 8) -> RandomForestClassificationModel:
    """The forest over labelled findings (path, before, candidate, label); a bounded set, as its caller chooses it."""
    x = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(findings)).select("features", F.col("label").cast("double"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=9, featureSubsetStrategy="sqrt").fit(x.coalesce(1))


def default_findings(spark: SparkSession) -> DataFrame:
    schema = "array<struct<path:string,before:string,candidate:string,after:string,label:int>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(labelled_findings())), schema)).alias("x")).select("x.*")


def parts(x: Column) -> Column:
    """The candidates in a match: an array of (start in the match, candidate, least length, whether a key word names it)."""
    part = lambda at, c, least, named: F.struct(at.cast("int").alias("at"), c.alias("candidate"), F.lit(least).alias("least"), F.lit(named).alias("named"))
    digit = lambda c: c.rlike("[0-9]")

    def named(lead: str, value: str, least: int) -> Column:
        name = F.regexp_extract(x, f"^{NAME}", 0)
        head = F.length(F.regexp_extract(x, f"^(?:{lead})(?={value}$){QUOTE}", 0))
        c = F.regexp_replace(x.substr(head + 1, F.length(x)), r"\\?[\"']$|[.,;:?\\]+$", "")
        inner = F.when(c.rlike(r"^\S+$"), F.length(F.regexp_extract(c, f"^(?:{LEAD}{QUOTE})(?=.{{4}})", 0))).otherwise(F.lit(0))
        whole = part(head + inner, c.substr(inner + 1, F.length(c)), least, True)
        return F.array(part(F.lit(0), name, 16, False), whole)

    # runs: pieces end behind their '=' signs, which are padding in the last piece only
    pieces = F.regexp_extract_all(x, F.lit("^=+|[^=]+=*"), F.lit(0))
    empty = F.array().cast("array<struct<at:int,candidate:string,least:int,named:boolean>>")
    cut = F.aggregate(
        pieces, F.struct(F.lit(0).alias("at"), empty.alias("got")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p)).alias("at"),
            F.concat(a["got"], F.array(part(a["at"], F.when(a["at"] + F.length(p) < F.length(x), F.regexp_replace(p, "=+$", "")).otherwise(p), 16, False))).alias("got"),
        ),
        lambda a: a["got"],
    )
    good = F.filter(cut, lambda y: (F.length(y["candidate"]) >= 16) & digit(y["candidate"]))
    runs = F.when((F.size(cut) > 1) & (F.size(good) > 0), cut).otherwise(F.array(part(F.lit(0), x, 16, False)))
    return (
        F.when(x.startswith("-----BEGIN"), F.array(part(F.lit(0), x, 1, True)))
        .when(x.rlike(f"^{LEAD}{VALUE}$"), named(LEAD, VALUE, 4)).when(x.rlike(rf"^{NAME}\s{{1,3}}{SPACED}$"), named(rf"{NAME}\s{{1,3}}", SPACED, 6)).otherwise(runs)
    )


def starts(lengths: str, per: int = 512) -> str:
    """SQL for the sums of an int array's items before each item, in two levels, so that no long array grows item by item."""
    running = "aggregate({}, array({}), (a, v) -> concat(a, array(element_at(a, -1) + v)))"
    pages = f"transform(sequence(0, (size({lengths}) - 1) div {per}), j -> slice({lengths}, j * {per} + 1, {per}))"
    sums = f"transform({pages}, x -> aggregate(x, 0, (t, v) -> t + v))"
    inside = f"slice({running.format('x', 'o')}, 1, size(x))"
    return f"flatten(zip_with({pages}, slice({running.format(sums, 0)}, 1, size({pages})), (x, o) -> {inside}))"


def candidates(documents: DataFrame, *keep: str | Column) -> DataFrame:
    """keep's columns, path, start (0-based, in characters), before, candidate, after: one row per candidate.

    A text is split at its matches, so places are sums of lengths and surroundings come from the pieces beside a match:
    work grows with the text's length, whatever the number of candidates. Null and empty texts, and an empty table, give
    no rows; repeated rows give their candidates each.
    """
    # all but runs hold a key word, so texts without any need no other pattern
    by_pattern = lambda f: F.when(F.col("text").rlike(HAS_KEY_WORD), f(CANDIDATE)).otherwise(f(RUN))
    kept = [F.col(k) if isinstance(k, str) else k for k in keep]
    rows = documents.select(*kept, F.col("source").cast("string").alias("path"), by_pattern(lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("_m"), by_pattern(lambda p: F.split("text", p, -1)).alias("_b"))
    names = rows.columns[: len(kept)]
    # pieces: text before, match, text before, match, ..; of each the ends that surroundings may need
    rows = rows.select(
        *names, "path", "_m", F.expr("flatten(zip_with(_b, _m, (b, m) -> array(b, coalesce(m, ''))))").alias("_pieces"),
        F.expr("transform(_b, b -> length(b))").alias("_gaps"), F.expr("zip_with(slice(_b, 1, size(_m)), _m, (b, m) -> length(b) + length(m))").alias("_lengths"),
    )
    near = 2 * -(-max(BEFORE, AFTER) // 4)  # matches have 4 characters or more
    rows = rows.select(
        *names, "path", "_m", "_gaps", F.when(F.size("_m") > 0, F.expr(starts("_lengths"))).alias("_starts"),
        F.expr(f"transform(_pieces, x -> right(x, {BEFORE}))").alias("_tails"), F.expr(f"transform(_pieces, x -> left(x, {AFTER}))").alias("_heads"),
    )
    item = f"""named_struct('match', x, 'start', _starts[i] + _gaps[i],
        'before', array_join(slice(_tails, greatest(1, 2 * i + 2 - {near}), least(2 * i + 1, {near})), ''), 'after', array_join(slice(_heads, 2 * i + 3, {near}), ''))"""
    # outer: the optimizer would run the pattern once more to look for empty arrays
    rows = rows.select(*names, "path", F.explode_outer(F.expr(f"transform(_m, (x, i) -> {item})")).alias("m")).filter("m is not null")
    rows = rows.select(*names, "path", "m", F.explode_outer(parts(F.col("m.match"))).alias("p")).filter("p is not null")
    length = F.length("p.candidate")
    rows = rows.select(
        *names, "path", (F.col("m.start") + F.col("p.at")).alias("start"), F.right(F.concat("m.before", F.substring("m.match", F.lit(1), F.col("p.at"))), F.lit(BEFORE)).alias("before"), F.col("p.candidate").alias("candidate"),
        F.left(F.concat(F.substring("m.match", F.col("p.at") + length + 1, F.length("m.match")), F.col("m.after")), F.lit(AFTER)).alias("after"), "p.least", "p.named",
    )
    beside = F.concat_ws(" ", "before", "after").rlike(f"(?i){KEY_WORDS}")
    rows = rows.filter((F.length("candidate") >= F.col("least")) & (F.col("named") | F.col("candidate").rlike("[0-9]") | beside))
    return rows.select(*names, "path", "start", "before", "candidate", "after")


def judged(found: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """found with score (the forest's share for a secret) and is_secret (score of 0.5 or more)."""
    x = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(with_features(found))
    scored = model.transform(x).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*found.columns, "score", (F.col("score") >= 0.5).alias("is_secret"))


def scanned(documents: DataFrame, model: RandomForestClassificationModel | None = None) -> DataFrame:
    """doc_id, start, length, finding, score, is_secret of every candidate in every whole text.

    A null doc_id stays null; null and empty texts give no rows, repeated rows their findings each.
    """
    model = model or trained(default_findings(documents.sparkSession))
    docs = documents.select(F.col("doc_id").cast("bigint"), F.col("source"), F.col("text"))
    found = judged(candidates(docs, "doc_id"), model)
    return found.select("doc_id", "start", F.length("candidate").alias("length"), F.col("candidate").alias("finding"), "score", "is_secret")


def redacted(documents: DataFrame, model: RandomForestClassificationModel | None = None) -> DataFrame:
    """documents with each secret replaced by MASK at its place, and n_chars renewed where there is one; no row goes.

    Each row is judged by itself: rows that repeat a doc_id or a text keep their own findings, and the same characters
    stay where they were judged harmless. Null and empty texts stay as they are; an empty table gives no rows.
    """
    model = model or trained(default_findings(documents.sparkSession))
    rows, key, _ = with_key(documents)
    hits_, at = f"{key}_hits", f"{key}_of"
    hits = judged(candidates(rows.select(F.col(key).alias("_row"), "source", "text"), "_row"), model).filter("is_secret")
    hits = written(hits.groupBy(F.col("_row").alias(at)).agg(F.array_sort(F.collect_set(F.struct(F.col("start").alias("s"), (F.col("start") + F.length("candidate")).alias("e")))).alias(hits_)), "secrets")
    out = rows.join(F.broadcast(hits) if fits_broadcast(hits, 400) else hits, rows[key] == hits[at], "left")
    # the text before each secret, from the end of the one before it, and the text behind the last
    before = f"transform(`{hits_}`, (h, i) -> substring(text, if(i = 0, 0, `{hits_}`[i - 1].e) + 1, greatest(0, h.s - if(i = 0, 0, `{hits_}`[i - 1].e))))"
    masked = F.expr(f"concat(array_join({before}, '{MASK}'), '{MASK}', substring(text, element_at(`{hits_}`, -1).e + 1))")
    clean = F.when(F.col(hits_).isNull(), F.col("text")).otherwise(masked)
    new = {"text": clean} | ({"n_chars": F.when(F.col(hits_).isNull(), F.col("n_chars")).otherwise(F.length(clean)).cast(documents.schema["n_chars"].dataType)} if "n_chars" in documents.columns else {})
    return out.select(*(new[c].alias(c) if c in new else rows[c] for c in documents.columns))
