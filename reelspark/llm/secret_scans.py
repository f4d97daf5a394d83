"""Secret scans (operator 3): candidates judged by a random forest, in SQL expressions throughout.

Candidates are values that a key word and = or : lead up to (8 or more characters other than space,
up to the quote that closes them), passwords in URLs, and all runs of 16 or more key characters,
with digits or without. Values with spaces are not candidates as a whole. The forest sees length, transitions
between kinds of characters, how much a dictionary covers, the path and the neighbouring words, and
is trained on labelled findings. Its trees become one SQL expression, so that a document's
candidates are found, judged and struck out in its own row, without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm.common import table

#: What leads up to a value; what stands before is looked at only where the character there fits.
LED = r"(?<=[=:>\s\"'])(?<=[=:]>?\s{0,3}[\"']?|\s)(?<=(?i:token|secret|pass|pwd|key|auth|credential)[\w.\-]{0,16}[\"'\])]{0,2}\s{0,3}[=:]{1,2}>?\s{0,3}[\"']?|(?i:bearer)\s{1,3})(?![=:>])"
CANDIDATE = (
    LED + r"""(?:(?<=")[^\s"]{8,}|(?<=')[^\s']{8,}|(?<!["'])[^\s"']{7,}[^\s"'.,;:)\]}])"""
    r"""|(?<=:)(?<=://[^\s/:@"']{0,40}:)[^\s/@"']{3,}+(?=@)"""
    r"""|(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}+={0,2}"""
)
#: Neighbouring characters on each side, and what a secret becomes.
NEAR = 48
MARK = "[SECRET]"
THRESHOLD = 0.5
TREES = 25
DEPTH = 7
#: Labelled findings that the default forest is trained on.
FINDINGS = 11000

#: Dictionary words that names, placeholders and prose are made of.
DICTIONARY = "the and for you your with from this that have not are was will can here token key secret password example sample test dummy fake placeholder changeme insert replace default value name user page index image photo large small chapter version release build config data file path local public static asset locale utf book item order number list date time".split()

#: SQL of each feature; c, before, after and path are a candidate's fields.
FEATURES = {
    "size": "length(c)",
    "digits": "length(regexp_replace(c, '[^0-9]', '')) / length(c)",
    "uppers": "length(regexp_replace(c, '[^A-Z]', '')) / length(c)",
    "transitions": "(length(regexp_replace(c, '(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])', ' ')) - length(c)) / length(c)",
    "separators": "length(regexp_replace(c, '[A-Za-z0-9]', '')) / length(c)",
    "variety": "size(array_distinct(split(lower(c), ''))) / least(length(c), 36)",
    "dictionary": "1 - length(regexp_replace(lower(c), '" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + "', '')) / length(c)",
    "hex": "if(c rlike '^[0-9a-f]+$' or c rlike '^[0-9A-F]+$', 1, 0)",
    "uuid": "if(c rlike '(?i)^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$', 1, 0)",
    "prefix": "if(c rlike '^(AKIA|ASIA|AIza|gh[opsu]_|glpat-|xox[abp]-|sk_live_|sk-|eyJ)', 1, 0)",
    "path_test": "if(path rlike '(?i)(test|fixture|mock|example|spec|docs?/|lock)', 1, 0)",
    "word_key": "if(before rlike '(?i)(token|secret|pass|api|key|auth|credential|bearer|pwd)[^\\n]{0,16}$', 1, 0)",
    "word_pass": "if(before rlike '(?i)(pass|pwd|secret|credential)[^\\n]{0,16}$', 1, 0)",
    "plain": "if(c rlike '^[A-Za-z]?[a-z]+$', 1, 0)",
    "cases": "length(regexp_replace(c, '[a-z][A-Z]|[A-Z][A-Z]', '')) / length(c)",
    "code": "if(c rlike '^[<{$%]|[(]|\\\\[|^[A-Za-z_]+[.][A-Za-z_.]+$|^(https?:)?/', 1, 0)",
    "in_url": "if(before rlike '://[^/@\\\\s]*:$' and after rlike '^@', 1, 0)",
    "word_sum": "if(before rlike '(?i)(commit|sha[0-9]*|md5|checksum|digest|hash|uuid|etag|integrity|revision|serial|isbn|phone|tel|card|iban)[^\\n]{0,16}$', 1, 0)",
    "assigned": "if(before rlike '[=:]\\\\s*[\"\\']?$', 1, 0)",
    "quoted": "if(before rlike '[\"\\']$' and after rlike '^[\"\\']', 1, 0)",
}


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """Labelled findings made by rule: (c, before, after, path, label), label 1 for real secrets.

    Values come from hashes of the row number; kinds of findings take turns.
    """
    hexes = "sha2(concat('finding', id), 256)"
    base = f"translate(base64(unhex({hexes})), '+/=', 'aB7')"
    word = "element_at(array('reader', 'service', 'la', 'und', 'de', 'worker', 'erhe', 'tion', 'client', 'mail'), cast(id % 10 as int) + 1)"
    key = "element_at(array('token', 'api_key', 'secret', 'access_token', 'password', 'auth', 'client_secret'), cast(id % 7 as int) + 1)"
    summed = "element_at(array('commit', 'sha1', 'checksum', 'digest', 'revision', 'md5', 'hash'), cast(id % 7 as int) + 1)"
    place = "element_at(array('', 'src7', 'app/settings.py', 'deploy/env', 'README'), cast(id % 5 as int) + 1)"
    letters = f"translate({base}, '0123456789', 'aQxTmKvBzR')"
    mixed = f"translate({base}, 'bdfhjlnprtBDF', '!@$.:#%&*?~^,')"
    prose = "element_at(array('international', 'required', 'something', 'Schraubenzieher', 'developpement', 'important', 'undefined', 'mandatory', 'disabled', 'management', 'administrator', 'incorrect', 'forgotten'), cast(id % 13 as int) + 1)"
    code = "element_at(array('os.environ[TOKEN]', 'getpass.getpass()', '${PASSWORD}', '<your-password>', 'self.password', 'request.form.password', 'settings.SECRET_KEY', '{{ secrets.API }}', 'process.env.API_KEY', 'https://example.org/reset', 'read_password(prompt)', '********', 'xxxxxxxxxxxx'), cast(id % 13 as int) + 1)"
    phrase = f"translate({hexes}, '0123456789', 'ghijklmnop')"
    passes = "element_at(array('password', 'passwd', 'pwd', 'secret', 'db_password', 'passphrase', 'credential'), cast(id % 7 as int) + 1)"
    camel = "concat('get', initcap({0}), 'From', initcap({0}), element_at(array('Factory', 'Handler', 'Manager', 'Provider'), cast(id % 4 as int) + 1))".format(word)
    kinds = [
        (f"substr({hexes}, 1, 40)", f"concat({key}, ' = \"')", "'\"'", place, 1),
        (f"substr({hexes}, 1, 32 + cast(id % 3 as int) * 16)", f"concat({key}, ': ')", "''", place, 1),
        (f"substr({base}, 1, 24 + cast(id % 16 as int))", f"concat({key}, '=')", "''", place, 1),
        (f"concat('AKIA', upper(substr({hexes}, 1, 16)))", "'aws_access_key_id = '", "''", place, 1),
        (f"concat('ghp_', substr({base}, 1, 36))", "'Authorization: Bearer '", "''", place, 1),
        (f"concat('sk_live_', substr({base}, 1, 24))", f"concat({key}, ' = \"')", "'\"'", place, 1),
        (f"substr({base}, 3, 20)", f"concat({key}, ' = \"')", "'\"'", place, 1),
        (f"substr({hexes}, 1, 40)", f"concat({summed}, ' ')", "' '", place, 0),
        (f"substr({hexes}, 1, 32 + cast(id % 2 as int) * 32)", f"concat({summed}, ': ')", "''", place, 0),
        (f"substr({base}, 1, 40)", "'integrity=\"sha512-'", "'\"'", place, 0),
        (f"concat_ws('-', substr({hexes}, 1, 8), substr({hexes}, 9, 4), substr({hexes}, 13, 4), substr({hexes}, 17, 4), substr({hexes}, 21, 12))", f"concat({word}, ' ')", "' '", place, 0),
        ("lpad(cast(pmod(xxhash64(id), 10000000000000000) as string), 16, '4')", f"concat({word}, ' ')", "' '", place, 0),
        ("lpad(cast(pmod(xxhash64(id), 10000000000000000) as string), 16 + cast(id % 4 as int), '37')", "'card '", "' '", place, 0),
        (f"concat('your-', replace({key}, '_', '-'), '-here-', id)", f"concat({key}, ' = \"')", "'\"'", place, 0),
        (f"concat('example_', {key}, '_placeholder_', id)", f"concat({key}, ': ')", "''", place, 0),
        (f"concat({word}, '-chapter-', id, '-of-the-book-', {word})", "''", "''", place, 0),
        (f"concat('static/images/', {word}, '-large-', id)", "'src=\"/'", "'.png'", place, 0),
        (f"concat('en_US_', {word}, '_release_', id)", "'locale='", "' '", place, 0),
        (f"substr({hexes}, 1, 40)", f"concat({key}, ' = \"')", "'\"'", "concat('tests/fixtures/', id, '.py')", 0),
        ("concat(repeat('-', 16 + cast(id % 30 as int)), id)", "''", "''", place, 0),
        (f"substr({letters}, 1, 20 + cast(id % 8 as int))", f"concat({key}, ' = \"')", "'\"'", place, 1),
        (f"substr({letters}, 1, 16 + cast(id % 9 as int))", f"concat({key}, '=')", "''", place, 1),
        (f"substr({base}, 1, 8 + cast(id % 8 as int))", f"concat({passes}, ' = \"')", "'\"'", place, 1),
        (f"substr({base}, 1, 8 + cast(id % 8 as int))", f"concat({passes}, ': ')", "''", place, 1),
        (f"concat(substr({mixed}, 1, 8 + cast(id % 9 as int)), 'x')", f"concat({passes}, '=')", "''", place, 1),
        (f"substr({mixed}, 1, 10 + cast(id % 12 as int))", f"concat({key}, ' = \"')", "'\"'", place, 1),
        (f"concat('eyJ', substr({base}, 1, 16), '.eyJ', substr({base}, 4, 20), '.', substr({base}, 2, 24))", "'Authorization: Bearer '", "''", place, 1),
        (f"concat('postgres://', {word}, ':', substr({base}, 1, 9), '@db.', {word}, '.org/main')", f"concat({key}, '=')", "''", place, 1),
        (f"substr({base}, 1, 5 + cast(id % 9 as int))", f"concat('https://', {word}, ':')", "'@host.org/a'", place, 1),
        (f"concat_ws('-', substr({phrase}, 1, 5), substr({phrase}, 7, 4), substr({phrase}, 13, 6), substr({phrase}, 21, 5))", f"concat({passes}, ' = \"')", "'\"'", place, 1),
        (f"substr({phrase}, 1, 18 + cast(id % 9 as int))", f"concat({passes}, ' = \"')", "'\"'", place, 1),
        (prose, f"concat({key}, ': ')", "' '", place, 0),
        (f"concat({prose}, '-', {word})", f"concat({passes}, ': ')", "' '", place, 0),
        (code, f"concat({passes}, ' = ')", "''", place, 0),
        (code, f"concat({key}, ': \"')", "'\"'", place, 0),
        (f"concat({word}, {prose}, {word})", "''", "' '", place, 0),
        (f"concat('/', {word}, '/', {prose}, '-', {word})", "'href=\"'", "'\"'", place, 0),
        (camel, "''", "'('", place, 0),
        (f"concat('my_', {word}, '_', {key}, '_setting')", "''", "' = '", place, 0),
        (prose, "'the bearer '", "' '", place, 0),
        ("repeat(element_at(array('-', '_', '/', '+'), cast(id % 4 as int) + 1), 16 + cast(id % 30 as int))", "''", "''", place, 0),
        ("repeat(element_at(array('x', 'A', 'ha', '-='), cast(id % 4 as int) + 1), 16 + cast(id % 30 as int))", "''", "''", place, 0),
        (f"concat({word}, {prose}, upper({word}), '/', {prose})", "''", "' '", place, 0),
    ]
    case = lambda k: "case " + " ".join(f"when id % {len(kinds)} = {i} then {row[k]}" for i, row in enumerate(kinds)) + " end"
    rows = spark.range(0, n, 1, 4)
    return rows.selectExpr(f"{case(0)} as c", f"concat({word}, ' ', {case(1)}) as before", f"concat({case(2)}, ' ', {word}) as after", f"{case(3)} as path", f"{case(4)} as label")


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> str:
    """SQL expression of the share of trees that call a candidate a secret; fields are FEATURES'
    names of a struct ``f``. ``findings`` has c, before, after, path and label."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    names = list(FEATURES)
    rows = findings.where("c <> '' and label is not null").selectExpr("cast(label as double) label", *(f"cast({sql} as double) {name}" for name, sql in FEATURES.items()))
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows.na.fill(0.0))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=3, featureSubsetStrategy="sqrt").fit(rows)

    def expression(node) -> str:
        if node.getClass().getSimpleName() == "LeafNode":
            return str(int(node.prediction()))
        split = node.split()
        return f"if(f.{names[split.featureIndex()]} <= {split.threshold()!r}D, {expression(node.leftChild())}, {expression(node.rightChild())})"

    return "(" + " + ".join(expression(t._java_obj.rootNode()) for t in model.trees) + f") / {float(trees)}D"


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from ``columns``."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def scanned(docs: DataFrame, forest: str, path: str | None, names: list[str]) -> DataFrame:
    """``docs`` with its findings, which are secrets, and the redacted text, as columns ``names``."""
    findings, secret, redacted = names
    c, gaps, seen, scores = free_names([*docs.columns, *names], "_c", "_gaps", "_seen", "_scores")
    text = "cast(text as string)"
    found = docs.withColumn(c, F.regexp_extract_all(F.expr(text), F.lit(CANDIDATE), 0))
    found = found.withColumn(gaps, F.when(F.size(c) > 0, F.split(F.expr(text), CANDIDATE, -1)))
    at = f"`{path}`" if path else "''"
    candidates = f"transform({c}, (c, i) -> struct(c as c, right(concat(if(i = 0, '', {c}[i - 1]), {gaps}[i]), {NEAR}) as before, left({gaps}[i + 1], {NEAR}) as after, coalesce(cast({at} as string), '') as path))"
    found = found.withColumn(seen, F.expr(f"case when size({c}) > 0 then {candidates} end"))

    def of(sql: str) -> str:
        parts = re.split(r"('(?:[^'\\]|\\.)*')", sql)
        return "".join(p if k % 2 else re.sub(r"\b(c|before|after|path)\b", r"x.\1", p) for k, p in enumerate(parts))

    struct = "named_struct(" + ", ".join(f"'{name}', cast({of(sql)} as double)" for name, sql in FEATURES.items()) + ")"
    found = found.withColumn(scores, F.expr(f"transform(transform({seen}, x -> {struct}), f -> {forest})"))
    found = found.withColumn(findings, F.expr(f"case when text is not null then coalesce(zip_with({seen}, {scores}, (x, s) -> struct(x.c as c, x.before as before, x.after as after, x.path as path, s as score)), cast(array() as array<struct<c: string, before: string, after: string, path: string, score: double>>)) end"))
    found = found.withColumn(secret, F.expr(f"transform({findings}, x -> x.score >= {THRESHOLD})"))
    struck = f"concat({gaps}[0], array_join(transform({findings}, (x, i) -> concat(if({secret}[i], '{MARK}', x.c), {gaps}[i + 1])), ''))"
    found = found.withColumn(redacted, F.expr(f"case when exists({secret}, s -> s) then {struck} else {text} end"))
    return found.drop(c, gaps, seen, scores)


def scan(docs: DataFrame, forest: str, path: str | None = None) -> DataFrame:
    """``docs`` with three more columns, read from ``text`` and, if given, the column ``path``.

    ``_findings``: array of (c, before, after, path, score) of every candidate in order; ``_secret``:
    whether each is one; ``_redacted``: the text with MARK in each secret's place. A null text has
    neither findings nor redacted text, an empty one no findings; a null path counts as empty. Rows
    stay as they are, repeated ones too; columns of those three names raise ValueError, all others
    stay; an empty table gives no rows.
    """
    names = ["_findings", "_secret", "_redacted"]
    if {x.lower() for x in docs.columns} & set(names):
        raise ValueError(f"the input has columns named {names}")
    return scanned(docs, forest, path, names)


def redact(docs: DataFrame, forest: str, path: str | None = None) -> DataFrame:
    """``docs``, same columns whatever their names, with secrets struck out of ``text`` and ``n_chars``,
    if there, counted anew. Nulls, empty texts, repeated rows and an empty table as in :func:`scan`."""
    names = free_names(docs.columns, "_findings", "_secret", "_redacted")
    out = scanned(docs, forest, path, names)
    _, secret, redacted = names
    changed = {"text": F.col(redacted)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.exists(secret, lambda s: s), F.length(redacted).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*(f"`{c}`" for c in docs.columns))


def op3_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), train(labelled_findings(spark)), "source")
    return found.select("doc_id", F.size("_findings").cast("bigint").alias("n_candidates"), F.size(F.filter("_secret", lambda s: s)).cast("bigint").alias("n_secrets"), F.sha2("_redacted", 256).alias("redacted_sha256"))
