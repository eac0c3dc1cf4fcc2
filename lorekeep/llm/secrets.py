"""Secret scans: candidates by pattern, false positives removed by a random forest (DataFrame and ML-pipeline functions only).

A candidate is a run of 16 or more characters of a key's alphabet with a letter and a digit, a web token in three parts, a
private-key block, the address of a chat hook, user and password in an address, or what is assigned to a word that announces a secret, if
it has a letter and a digit or sign, up to white space, a quote or a separator. Its features are length, changes of character class, dictionary coverage, share of different
characters, digits and upper case, shape (hexadecimal, identifier, dashes), path and neighbouring words. A forest fitted on
labelled findings decides; its trees are then written as one SQL expression, so that scan, verdict and redaction happen
within the row: nothing is exploded or shuffled.

Labelled findings are a table (before, candidate, after, label). Where none is given, `labelled` makes TRAIN_ROWS of them: keys,
half of them without a word that announces them, against checksums, identifiers, paths and names, and against what stands where a
key would: placeholders, sequences, variable names and checksums after `token =`. Shapes and words occur on either side,
but a hexadecimal run that nothing announces is a commit's or a file's digest there, never a key.
The dictionary is WORDS and, from `corpus_words`, the most frequent words of the texts themselves, counted over all of them.

Null and empty texts have no findings. Repeated rows are scanned each; extra columns pass through, but one named findings (`scan`)
or n_secrets (`redact`) is replaced. Texts of any length are scanned whole; a document's candidates are taken apart once, by one split.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, let

#: Rows of labelled findings that the forest is fitted on at most; trees and depth.
TRAIN_ROWS, TREES, DEPTH, SEED, THRESHOLD = 8000, 16, 8, 11, 0.5
#: Words of the corpus that join the dictionary, of LETTERS letters at least.
VOCABULARY, LETTERS = 1000, 4
#: Words of the dictionary that generated names are made of.
NAME_WORDS = 200
#: What may be a secret. A run of any length is one candidate; possessive quantifiers, since what ends a run isn't part of it.
ASSIGNED = r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|credential)s?[\"']?\s{0,3}[=:]"
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}+-----END [A-Z ]{0,30}PRIVATE KEY-----"
    r"|\beyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
    r"|\bhooks\.slack\.com/services/[A-Za-z0-9/]{20,}+"
    r"|(?<=://)[^\s:/@\"'<>]{0,64}+:[^\s/@\"'<>]{3,}+(?=@)"
    # what precedes is looked at in steps, the cheapest first; the last character isn't a sentence's
    # (what is looked for ahead comes before a further = or :, so that no run is looked through twice)
    r"|(?<=[=:\"'\s])(?<=[=:]\s{0,3}[\"']?)(?<=" + ASSIGNED + r"\s{0,3}[\"']?)(?=[^\s\"'<>&;,=:]*?[A-Za-z])(?=[^\s\"'<>&;,=:]*?[0-9!#$%*+?@^~|])[^\s\"'<>&;,(\[{][^\s\"'<>&;,]{4,}[^\s\"'<>&;,.:)\]}]"
    r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}"
)
#: A pre-test that every candidate passes.
HINT = r"[A-Za-z0-9+/_-]{16}|\beyJ|-----BEGIN|://[^\s:/@\"'<>]{0,64}+:|" + ASSIGNED
#: Words whose letters make a candidate look like a name, words that announce a secret, and words that announce
#: another kind of digest.
WORDS = [
    "the", "and", "for", "with", "from", "user", "file", "data", "name", "image", "index", "page", "test", "version", "config", "build", "release", "server", "client", "module", "package", "class", "table", "column",
    "order", "value", "model", "view", "list", "item", "type", "size", "time", "date", "report", "chapter", "section", "article", "example", "static", "assets", "script", "style", "public", "private", "service", "system",
    "backup", "archive", "document", "default", "template", "component", "request", "response", "product", "country", "language", "number", "string", "object", "array", "update", "content", "media", "video", "audio",
]
ANNOUNCE = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api[_ -]?key|access[_ -]?key|credential|bearer|authorization|private[_ -]?key|auth)\W{0,12}$"
OTHER = r"(?i)(sha-?(1|256|512)|md5|checksum|digest|commit|revision|hash|etag|uuid|guid|integrity|fingerprint|build|version|id)\W{0,12}$|\.\.$"
PLACEHOLDER = r"(?i)example|sample|placeholder|change-?_?me|your[-_]|dummy|insert|redacted|(.)\1{5}|0?123456|abcdef0?1?2?3|qwerty|^[$][A-Z_{(]|^%\w+%$|\w\(|[a-z]\[|^(user(name)?|login)?:(pass(word)?|pw|secret)$"
FEATURES = ["placeholder", "length", "changes", "dictionary", "different", "digits", "upper", "hex", "dashes", "signs", "user", "known", "path", "announced", "other", "assigned", "quoted"]


def corpus_words(docs: DataFrame, text: str = "text", n: int = VOCABULARY) -> list[str]:
    """The n most frequent words (a-z, lower case) of all texts, ties by word: counted with map-side combination, n come to the driver."""
    words = F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(f"([a-z]{{{LETTERS},}})"), F.lit(1)))
    top = docs.select(words.alias("w")).groupBy("w").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.col("n").desc(), "w").limit(n)
    return [r["w"] for r in top.collect()]


def features(before: Column, c: Column, after: Column, words: list[str] | None = None) -> Column:
    """Struct of FEATURES, doubles. words: dictionary besides WORDS."""
    n = F.char_length(c).cast("double")
    classes = F.translate(c, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "0" * 10)
    share = lambda rx: F.regexp_count(c, F.lit(rx)) / n
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    cover = (n - F.char_length(F.regexp_replace(F.lower(c), "|".join(sorted({*WORDS, *(words or [])}, key=lambda w: (-len(w), w))), ""))) / n
    known = c.rlike(r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}|^hooks[.]|^sk-|^xox[abprs]-|^AIza|^eyJ|^-----BEGIN|^glpat-|^npm_")
    values = [
        flag(c.rlike(PLACEHOLDER)),
        F.least(n, F.lit(200.0)),
        F.regexp_count(classes, F.lit("(?<=a)[^a]|(?<=A)[^A]|(?<=0)[^0]")) / n,
        cover,
        F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64.0)),
        share("[0-9]"),
        share("[A-Z]"),
        flag(c.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        share("[-_/+]"),
        share(r"[!#$%&*+?@^~|]"),
        flag(before.rlike("://$") & c.contains(":")),
        flag(known),
        flag(before.rlike(r"[/\\.]$|https?://\S*$|[\w.-]+/$") | c.contains("/") & (share("/") > 0.08)),
        flag(before.rlike(ANNOUNCE)),
        flag(before.rlike(OTHER) | after.rlike(r"^\.\.")),
        flag(before.rlike(r"[=:]\s*['\"]?$")),
        flag(before.rlike(r"['\"]$") & after.rlike(r"^['\"]")),
    ]
    return F.struct(*[v.cast("double").alias(k) for k, v in zip(FEATURES, values, strict=True)])


def labelled(spark: SparkSession, rows: int = TRAIN_ROWS, seed: int = SEED, words: list[str] | None = None) -> DataFrame:
    """Labelled findings (before, candidate, after, label), made from hashes of row numbers. words: what names are made of besides WORDS."""
    d = spark.range(0, rows, 1, 4)
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(len(xs))) + 1).cast("int"))
    of = lambda n, *xs: F.element_at(F.array(*xs), n + 1)
    hx = lambda k: F.sha2(F.concat_ws("/", "id", F.lit(seed), F.lit(k)), 256)
    b64 = lambda k: F.translate(F.base64(F.unhex(hx(k))), "=\r\n", "")
    num = lambda k, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(n)).cast("int")
    vocabulary = sorted({*WORDS, *(words or [])[:NAME_WORDS]})
    w = lambda k: pick(vocabulary, k)
    plain = [F.substring(hx(1), 1, 40), F.substring(hx(1), 1, 32), hx(1)]  # a key and a checksum look alike
    other_than_plain = num(9, 26).between(6, 9) & (num(3, 10) < 3)
    key = of(
        F.when(other_than_plain, 3 + num(3, 10)).otherwise(num(3, 10)), *plain, b64(1), F.substring(F.translate(b64(1), "+/", "xY"), F.lit(1), 20 + num(2, 20)), F.concat(F.lit("AKIA"), F.upper(F.substring(hx(1), 1, 16))), F.concat(F.lit("ghp_"), F.substring(F.translate(b64(1), "+/", "aB"), 1, 36)),
        F.concat(F.lit("sk-"), F.translate(b64(1), "+/", "cD")), F.concat(F.lit("eyJ"), b64(1), F.lit("."), b64(2), F.lit("."), b64(3)), F.concat(F.substring(F.translate(b64(1), "+/", "aZ"), 1, 10), F.lit("-"), F.substring(F.translate(b64(2), "+/", "q7"), 1, 12)),
    )
    digest = of(num(3, 4), *plain, F.concat_ws("-", F.substring(hx(1), 1, 8), F.substring(hx(1), 9, 4), F.substring(hx(1), 13, 4), F.substring(hx(1), 17, 4), F.substring(hx(1), 21, 12)))
    name = of(
        num(3, 5), F.concat_ws("/", w(4), w(5), F.concat(w(6), num(7, 99).cast("string"))), F.concat_ws("_", w(4), w(5), w(6), num(7, 2030).cast("string")), F.concat_ws("-", w(4), w(5), w(6), num(7, 2030).cast("string")),
        F.concat(F.initcap(w(4)), F.initcap(w(5)), F.initcap(w(6)), F.initcap(w(8)), num(7, 99).cast("string")), F.concat(w(4), w(5), w(6), w(8), num(7, 9999).cast("string")),
    )
    stand_in = of(
        num(3, 8), F.concat(F.lit("your_"), w(4), F.lit("_key_here_"), num(7, 99).cast("string")), F.concat(F.lit("EXAMPLE"), F.upper(F.substring(hx(1), 1, 16))), F.concat(F.lit("changeme"), num(7, 99999999).cast("string"), F.lit("00000")), F.concat(F.repeat(pick(["x", "0", "a", "f"], 5), 24 + num(6, 16)), F.lit("a1")),
        F.concat(F.lit("0123456789abcdef"), F.repeat(F.lit("0123456789abcdef"), num(6, 3))), F.concat(F.upper(w(4)), F.lit("_"), F.upper(w(5)), F.lit("_TOKEN_"), num(7, 9).cast("string"), F.lit("_V2")), F.concat_ws("/", F.lit("etc"), w(4), w(5), F.concat(F.lit("key"), num(7, 99).cast("string"))), F.concat(F.lit("abcdef0123456789"), F.substring(hx(1), 1, 4)),
    )
    secrets_ = ['token = "', "secret: ", "password=", "api_key = '", "API-Key: ", "Authorization: Bearer ", 'access_key="', "auth ", "credentials ", "pwd: ", "private_key: "]
    neutral = ["see ", "in the ", "", "name ", "open ", '"', "value: ", "use ", "x = '", "ref: ", "k=", "https://example.com/?q="]
    sums = ["sha256: ", "commit ", "md5 ", "checksum ", "uuid = ", "hash: ", 'etag "', "revision ", "integrity=sha256 ", "build ", "id: ", "token sha256: ", "secret checksum "]
    sign = lambda k: pick(["!", "#", "$", "%", "*", "?", "@", "^", "~", "|", ".", "_"], k)
    short = lambda k, n: F.substring(F.translate(b64(k), "+/=", "x7Q"), F.lit(1), n)
    password = of(num(3, 4), F.concat(F.initcap(w(4)), sign(5), short(1, 3 + num(6, 8))), F.concat(short(1, 4 + num(6, 9)), sign(5), short(2, 2 + num(7, 6)), sign(8)), F.concat(w(4), sign(5), w(6), sign(7), num(8, 9999).cast("string")), short(1, 8 + num(6, 8)))
    user = F.concat(pick(["admin", "root", "svc", "app", "deploy", "me"], 11), F.lit(":"), password)
    assigned = ["password: ", 'password = "', "pwd=", "passwd: '", "secret = ", "token: ", "api_key=", 'secret: "', "access-key: ", "passphrase = "]
    address = ["postgres://", "https://", "mysql://", "at redis://", "amqp://", "ftp://"]
    not_password = of(
        num(3, 6), F.concat(F.lit("$"), F.upper(w(4)), num(5, 9).cast("string")), F.concat(w(4), F.lit("."), w(5), F.lit("[1")), F.concat(F.lit("get_"), w(4), F.lit("(1")), F.concat(w(4), pick(["!", "?", "-2", "1", "#1"], 5)), F.concat(num(5, 64).cast("string"), F.lit("-"), w(4)), F.concat(w(4), F.lit("/"), w(5), F.lit("?"), w(6)),
    )
    not_user = pick(["user:password", "username:password", "user:pass", "login:secret", "user:pw", ":password"], 5)
    places = ["/", "file ", "https://example.com/", "the page ", "src/", "see ", "import ", "in the ", "= ", '"']
    part = num(9, 26)  # 0-9 keys, then digests, names, stand-ins; 20-22 passwords and users' addresses, 23-25 what looks like those
    label = (part < 10) | part.between(20, 22)
    lead = pick(["It was so that ", "the end. ", "config ", "\n", "et de la ", "und die ", ""], 13)
    intro = (
        F.when(part < 6, pick(secrets_, 10)).when(part < 10, pick(neutral, 10)).when(part < 14, F.when(num(14, 2) == 0, pick([*neutral, "merge ", "fixed in ", "since ", "(", "from "], 10)).otherwise(pick(sums, 10)))
        .when(part < 18, F.when(num(14, 4) == 0, pick(secrets_, 10)).otherwise(pick(places, 10)))
        .when(part.isin(22, 25), pick(address, 10)).when(part >= 20, pick(assigned, 10)).otherwise(F.when(num(14, 4) == 0, pick(neutral, 10)).otherwise(pick(secrets_, 10)))
    )
    before = F.concat(lead, intro)
    # a key without a word before it is told by its shape: bare hexadecimal runs there are no keys
    shape = F.when(part == 22, user).when(part.between(20, 21), password).when(part == 25, not_user).when(part >= 23, not_password).when(label, key).when(part < 14, digest).when(part < 18, name).otherwise(stand_in)
    last = F.substring(before, -1, 1)
    after = F.when(part.isin(22, 25), F.lit("@db.host/")).when(part.between(10, 13) & (num(15, 6) == 0), F.lit("..")).when(last == '"', F.lit('" of')).when(last == "'", F.lit("' of")).otherwise(F.lit(" of the"))
    return d.select(before.alias("before"), shape.alias("candidate"), after.alias("after"), label.cast("double").alias("label"))


def fit(findings: DataFrame, rows: int = TRAIN_ROWS, words: list[str] | None = None) -> RandomForestClassificationModel:
    """A forest on at most `rows` labelled findings; words as in `features`."""
    x = findings.limit(rows).select("label", features(F.col("before"), F.col("candidate"), F.col("after"), words).alias("f")).select("label", "f.*")
    x = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(x).select("label", "v").coalesce(4)
    return RandomForestClassifier(labelCol="label", featuresCol="v", numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=5).fit(x)


def as_expression(model: RandomForestClassificationModel, f: Column) -> Column:
    """The forest's probability of label 1, as nested conditions on the struct f."""

    def walk(node) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            a, b = list(node.impurityStats().stats())
            return F.lit(float(b) / max(float(a + b), 1e-9))
        s = node.split()
        return F.when(f[FEATURES[s.featureIndex()]] <= float(s.threshold()), walk(node.leftChild())).otherwise(walk(node.rightChild()))

    total = None
    for t in model.trees:
        p = walk(t._call_java("rootNode"))
        total = p if total is None else total + p
    return total / len(model.trees)


def kind_of(c: Column, before: Column) -> Column:
    out = F.when(before.rlike("://$") & c.contains(":"), "userinfo").when(c.rlike("[^A-Za-z0-9+/_=-]") | (F.char_length(c) < 16), "password").otherwise("generic")
    for k, rx in (("hex", "^[0-9a-fA-F]+$"), ("private_key", "^-----BEGIN"), ("jwt", "^eyJ[^.]*[.]"), ("github", "^gh[pousr]_"), ("cloud_key", "^(AKIA|ASIA)"), ("hook", "^hooks[.]"), ("api_key", "^sk-|^AIza|^xox|^glpat-|^npm_")):
        out = F.when(c.rlike(rx), F.lit(k)).otherwise(out)
    return out


def _found(docs: DataFrame, model: RandomForestClassificationModel, text: str, words: list[str] | None, name: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:int,length:int,kind:string,candidate:string,probability:double,secret:boolean>>")
    hits, rest = free(docs, "_hits", "_rest")
    d = docs.withColumn(hits, F.when(t.rlike(HINT), F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>")))
    d = d.withColumn(rest, F.when(F.size(hits) > 0, F.split(t, CANDIDATE)).otherwise(F.array().cast("array<string>")))
    run = lambda k: F.aggregate(F.slice(rest, F.lit(1), k + 1), F.lit(0), lambda a, x: a + F.char_length(x)) + F.aggregate(F.slice(hits, F.lit(1), k), F.lit(0), lambda a, x: a + F.char_length(x))

    def one(c: Column, k: Column) -> Column:
        # before and after as far as the patterns look; the candidate before, if adjacent, is not part of it
        before = F.substring(F.get(rest, k), -64, 64)
        f = features(before, c, F.substring(F.get(rest, k + 1), 1, 16), words)
        verdict = let(f, lambda v: as_expression(model, v))
        return let(verdict, lambda p: F.struct(run(k).alias("start"), F.char_length(c).alias("length"), kind_of(c, before).alias("kind"), c.alias("candidate"), F.round(p, 6).alias("probability"), (p >= THRESHOLD).alias("secret")))

    return d.withColumn(name, F.when(F.size(hits) == 0, none).otherwise(F.transform(hits, one))).drop(hits, rest)


def scan(docs: DataFrame, model: RandomForestClassificationModel, text: str = "text", words: list[str] | None = None) -> DataFrame:
    """docs with findings: array of (start, length, kind, candidate, probability, secret) in order; start counts code points from 0. words
    as in `fit`.

    The text is split at its candidates once; a place is the running length of what precedes it. Texts without a candidate
    stop at one pattern test."""
    return _found(docs, model, text, words, "findings")


def redact(docs: DataFrame, model: RandomForestClassificationModel, text: str = "text", words: list[str] | None = None) -> DataFrame:
    """docs with each secret in the text replaced by [SECRET:kind], and n_secrets."""
    (own,) = free(docs, "_secrets")
    d = _found(docs, model, text, words, own).withColumn(own, F.filter(own, lambda x: x["secret"])).withColumn("n_secrets", F.size(own))
    piece = lambda x, k: F.concat(
        let(F.coalesce(F.get(own, k - 1)["start"] + F.get(own, k - 1)["length"], F.lit(0)), lambda b: F.substring(F.col(text), b + 1, x["start"] - b)), F.lit("[SECRET:"), x["kind"], F.lit("]")
    )
    last = let(F.get(own, F.size(own) - 1), lambda x: F.substring(F.col(text), x["start"] + x["length"] + 1, F.char_length(text)))
    clean = F.when(F.size(own) == 0, F.col(text)).otherwise(F.concat(F.array_join(F.transform(own, piece), ""), last))
    return d.withColumn(text, clean).drop(own)
