"""Secret scanning in DataFrame expressions alone: candidate strings of a text, features of each
and of its surroundings, and a random forest, trained on labelled findings, that removes false
positives. Training histograms are DataFrame aggregations; the forest itself is literal arrays
that higher-order functions walk through.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import forget, save

#: Labelled findings that training uses at most, the forest's shape, and histogram bins.
TRAIN_ROWS, TREES, DEPTH, BINS, LEAST, SEED = 20_000, 12, 6, 24, 6, 11
NODES = 2 ** (DEPTH + 1) - 1
#: Characters looked at on either side.
BEFORE, AFTER = 64, 32
# What a candidate is made of, and the words that speak for or against it.
CANDIDATE = r"[A-Za-z0-9+/_.=\-]{16,}"
_NAMES = (
    r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_\-]?key|access[_\-]?key|auth(?:orization)?|bearer|credentials?|private[_\-]?key|key"
    r"|passwort|kennwort|losungswort|geheim(?:nis|wort)|schl(?:ü|ue)ssel|zugangsdaten|mot[ _\-]?de[ _\-]?passe|mdp|phrase[ _\-]secr[eè]te|identifiants?|jeton"
    r"|contrase(?:ñ|n)a|clave|palabra[ _\-]de[ _\-]paso|frase[ _\-]secreta|credencial(?:es)?)"
)
KEYWORDS = rf"(?i){_NAMES}[\x22']?\s*(?:[=:]|=>)?\s*[\x22']?$"
HARMLESS = r"(?i)(?:sha\d*|md5|commit|checksum|hash|digest|uuid|guid|etag|integrity|order|invoice|card|phone|tel|version|file|path|see|page|isbn|doi|id)[\x22']?\s*(?:[=:#])?\s*[\x22']?$"
_PREFIXES = "(?:AKIA|ASIA|gh[opsu]_|xox[abprs]-|sk_live_|sk_test_|eyJ|AIza|glpat-|npm_)"
PREFIX = "^" + _PREFIXES
#: A run is a candidate with a digit, with a capital behind a small letter, or with a key's prefix.
TELLING = "[0-9]|[a-z][A-Z]|(?:^|[^A-Za-z0-9])" + _PREFIXES
#: An assignment: its name and what stands before the value, and the value: VALUE_CHARS or more of
#: any characters but spaces, to the closing quote, if quoted, or else to the next assignment, a tag
#: or punctuation before a space. (Behind 256 characters to the next space: Java would recurse.)
VALUE_CHARS = 6
_HEAD = rf"(?i){_NAMES}[\x22']?\s*+(?:=>|:=|[=:]++)\s*+(?:(?:bearer|basic)\s++)?+[\x22'`]?+"
_PLAIN = r"(?!</|[&;,][\x22']?[A-Za-z_]\w{0,30}[\x22']?[=:]|[,;.:)\]}>\x22'`]{0,8}+(?:\s|$))\S"
ASSIGNED = rf"{_HEAD}(?![^\sA-Za-z0-9]{{0,8}}{_NAMES}[\x22']?\s{{0,8}}[=:])(?:(?<=\x22)[^\x22\s]{{{VALUE_CHARS},}}+(?=\x22)|(?<=')[^'\s]{{{VALUE_CHARS},}}+(?=')|(?:{_PLAIN}){{256}}+\S*+|(?:{_PLAIN}){{{VALUE_CHARS},255}}+)"
#: A password between a user's name and the host of an address.
_USER = r"(?<![A-Za-z0-9+.\-])[A-Za-z][A-Za-z0-9+.\-]{1,20}://[^\s/:@?#\x22'<>]{0,64}:"
ADDRESSED = _USER + r"[^\s/@\x22'<>]{3,256}+(?=@)"
VALUES = f"{ADDRESSED}|{ASSIGNED}"
PLACEHOLDER = r"(?i)(.)\1{4,}|example|changeme|placeholder|your|dummy|0123456|123456789|abcdefg|xxxx"
FILE = r"(?i)\.(?:com|org|net|edu|gov|io|html?|php|png|jpe?g|gif|svg|js|css|py|java|txt|md|json|xml|ya?ml|pdf|zip|gz)(?:$|[/.])"
WORDS = "about account address after again all also and any app are back base been before block body build button call can case change class client code color com common config content control copy count create current data date default delete device docs document each edit element email end error event every example file first font for form from full function get git global group have head help home html http image index info input into item java key label last level line link list load local lock log login main make map master media member menu message method model module more name net new next node not number object open option order org other out over page param part path people phone photo post print product public query read record request return right root save script search section select send server service session set show site size source start state status string style system table test text that the their there these this time title tool top type update upload user value version video view was web what when where which will window with word work world www year you your".split()
FEATURES = 22
#: Words of the corpus that count as a dictionary: those in the most documents, of DICTIONARY_LETTERS
#: letters at least.
DICTIONARY, DICTIONARY_LETTERS = 4096, 3


def _share(n: Column, length: Column) -> Column:
    return n.cast("double") / F.greatest(length, F.lit(1))


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY) -> list[str]:
    """The ``most`` words that occur in the most documents, lower-cased; ties in their order. All
    documents are counted; ``most`` words come to the driver and go into the plan."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(rf"\p{{L}}{{{DICTIONARY_LETTERS},24}}"), F.lit(0)))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    # written by a task that merges the partitions' first ones: collected at once, all of them would
    # meet in the driver
    top = save(counts.where("n > 1").orderBy(F.desc("n"), "word").limit(most), "secret-words")
    first = [r[0] for r in top.orderBy(F.desc("n"), "word").collect()]
    forget(top)
    return first


def features(candidate: Column, before: Column, after: Column, dictionary: list[str] = ()) -> Column:
    """An array of FEATURES doubles. Where the candidate is key=value, the key counts as what
    stands before the value."""
    cut = F.regexp_extract(candidate, r"^([A-Za-z_.\-]{2,30}=+)(?=[^=])", 1)
    value = F.substr(candidate, F.length(cut) + 1)
    around = F.concat(before, cut)
    n = F.length(value)
    lower = F.lower(value)
    count = lambda pattern: F.regexp_count(value, F.lit(pattern))
    parts = F.transform(F.regexp_extract_all(value, F.lit(r"\p{Lu}?\p{Ll}+|\p{Lu}+"), F.lit(0)), F.lower)
    known = F.filter(parts, lambda w: w.isin(list(dictionary))) if len(dictionary) else F.array().cast("array<string>")
    in_words = F.aggregate(known, F.lit(0), lambda a, w: a + F.length(w))
    covered = n - F.length(F.regexp_replace(lower, "|".join(sorted(WORDS, key=lambda w: (-len(w), w))), ""))
    letters = count("[A-Za-z]")
    flag = lambda c: c.cast("double")
    return F.array(
        n.cast("double"),
        _share(count("[0-9]"), n),
        _share(count("[A-Z]"), n),
        _share(count("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"), n),
        _share(count("[a-z](?=[A-Z])|[A-Z](?=[a-z])"), n),
        _share(covered, n),
        _share(F.size(F.array_distinct(F.split(value, ""))), n),
        flag(value.rlike("^[0-9a-f]+$|^[0-9A-F]+$") & value.rlike("[A-Fa-f]")),
        flag(value.rlike("^[0-9.\\-]+$")),
        _share(count("[.]"), n),
        _share(count("[/]"), n),
        flag(value.rlike(FILE)),
        _share(count("(?i)[aeiou]"), letters),
        flag(around.rlike(KEYWORDS)),
        flag(around.rlike(HARMLESS)),
        flag(value.rlike(PREFIX)),
        flag(value.rlike(PLACEHOLDER)),
        flag(around.rlike("[@/]$") | after.rlike("^[@]")),
        flag(around.rlike("[\\x22']$") & after.rlike("^[\\x22']")),
        _share(count("[_\\-]"), n),
        _share(in_words, n),
        flag(before.rlike(r"://[^\s/@]{0,64}:$") & after.startswith("@")),
    )


def _running(lengths: str) -> Column:
    """Running sums of an array column, in blocks of about its size's square root: a whole prefix
    for each element would cost the square of the size."""
    width = F.greatest(F.lit(1), F.floor(F.sqrt(F.size(lengths).cast("double"))).cast("int"))
    none = F.array().cast("array<bigint>")
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))
    within = lambda k: F.aggregate(F.slice(lengths, k * width + 1, width), state(F.lit(0).cast("long"), none), lambda a, x: state(a["at"] + x, F.array_append(a["out"], a["at"] + x)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / width).cast("int")), within)
    place = lambda all_: F.aggregate(all_, state(F.lit(0).cast("long"), none), lambda a, x: state(a["at"] + x["at"], F.array_append(a["out"], a["at"])))["out"]
    whole = F.transform(F.array(blocks), lambda all_: F.flatten(F.zip_with(all_, place(all_), lambda x, at: F.transform(x["out"], lambda v: v + at))))
    return F.get(whole, 0)


def _hits(docs: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """Each match of each text: id, nth, end of what stands before it, the match, and the text
    between it and its neighbours (left and right)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), text.alias("whole")).where(F.size("hits") > 0)
    found = found.select("id", "hits", F.split("whole", pattern, -1).alias("gaps"))
    # what stands between the end of the last match and the end of this one's gap
    steps = F.zip_with(F.slice("gaps", 1, F.size("hits")), F.concat(F.array(F.lit("")), F.slice("hits", 1, F.size("hits") - 1)), lambda gap, hit: (F.length(gap) + F.length(hit)).cast("long"))
    found = found.withColumn("steps", steps).withColumn("ends", _running("steps"))
    rows = found.select("id", F.posexplode(F.arrays_zip("hits", "ends", F.slice("gaps", 1, F.size("hits")).alias("left"), F.slice("gaps", 2, F.size("hits")).alias("right"))).alias("nth", "x"))
    return rows.select("id", "nth", F.col("x.ends").cast("int").alias("end"), F.col("x.hits").alias("hit"), F.col("x.left").alias("left"), F.col("x.right").alias("right"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each candidate of each text: id, nth, start (in code points, from 0), candidate, before and
    after. Runs of 16 or more of CANDIDATE's characters that are TELLING are candidates, and so are
    passwords inside addresses and the values of ASSIGNED, names in four languages, that lie in no
    such run. nth counts from 0 for runs, and from -1 downwards for the others."""
    runs = _hits(docs, id_col, text_col, CANDIDATE).where(F.col("hit").rlike(TELLING))
    runs = runs.select("id", "nth", F.col("end").alias("start"), F.col("hit").alias("candidate"), F.right("left", F.lit(BEFORE)).alias("before"), F.left("right", F.lit(AFTER)).alias("after"))
    values = _hits(docs, id_col, text_col, VALUES).withColumn("head", F.regexp_extract("hit", f"^(?:{_USER}|{_HEAD})", 0))
    values = values.select("id", (-1 - F.col("nth")).alias("nth"), (F.col("end") + F.length("head")).alias("start"), F.substr("hit", F.length("head") + 1).alias("candidate"), F.right(F.concat("left", "head"), F.lit(BEFORE)).alias("before"), F.left("right", F.lit(AFTER)).alias("after"))
    one = CANDIDATE.split("{")[0]
    run = F.concat(F.regexp_extract("before", one + "*$", 0), "candidate", F.regexp_extract("after", f"^{one}*", 0))
    inside = F.col("candidate").rlike(f"^{one}+$") & (F.length(run) >= 16) & run.rlike(TELLING)
    return runs.unionByName(values.where(~inside))


def labelled_findings(spark: SparkSession, rows: int = 6_000, seed: int = SEED) -> DataFrame:
    """Findings as a review would label them, made from a rule: candidate, before, after and label
    (1: a secret). Kinds of secrets: assigned passwords and tokens, cloud and service keys, signed
    tokens, short passwords, pass phrases, passwords in addresses. Of others: numbers, hosts, paths,
    words, identifiers, checksums, placeholders, and words and code behind a secret's name."""
    r = lambda salt, n: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), F.lit(n))
    hexa = F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{seed}")), 512)
    hex_upper = F.upper(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"+{seed}")), 512))
    base = F.regexp_replace(F.base64(F.unhex(hexa)), "\\s", "")
    plain = F.translate(base, "+/=", "xYz")
    pick = lambda salt, options: F.get(F.array(*map(F.lit, options)), r(salt, len(options)).cast("int"))
    word = lambda salt: pick(salt, WORDS)
    made = F.translate(F.left(F.lower(plain), F.lit(30)), "bcdfghjklmnpqrstvwxyz0123456789", "eratinsoelereatintheonaiouernt")
    digits = F.translate(F.left(hexa, F.lit(24)), "abcdef", "493817")
    name = F.array_join(F.array(*map(word, "abcd")), "\0")
    name = F.replace(name, F.lit("\0"), pick("join", ["_", "-", ".", "/", ""]))
    assign = ["password: ", "db_password: ", 'password = "', "passwd=", "pwd: ", "secret: ", "secret=", "token: ", "api_key = '", "auth_token=", "passphrase: ", "credentials: ", "Passwort: ", "Kennwort = ", "mot de passe : ", "mdp=", "contraseña: ", "clave = "]
    address = F.concat(pick("p1", ["postgres", "mysql", "mongodb", "https", "redis", "amqp", "ftp"]), F.lit("://"), F.when(r("p2", 8) > 0, word("u")).otherwise(""), F.lit(":"))
    host = F.concat(F.lit("@"), word("w"), pick("p3", [".com/", ".local:5432/", "-db", ".internal/x", ""]))
    kinds = [  # candidate, what ends the text before it, what follows, label
        (F.concat(pick("k", ["password=", "passwd=", "pwd=", "secret=", "token=", "api_key=", "auth="]), F.left(hexa, F.lit(12) + r("n", 24).cast("int"))), F.concat(word("w"), F.lit(" ")), F.concat(F.lit(" "), word("x")), 1),
        (F.left(hexa, pick("n", [32, 40, 64])), pick("k", ['token = "', 'secret: "', "api_key = '", 'access_key="', "Authorization: Bearer ", "private_key: "]), pick("q", ['"', "'", " "]), 1),
        (F.concat(pick("k", ["AKIA", "ASIA"]), F.left(F.translate(hex_upper, "0189", "QWXZ"), F.lit(16))), F.concat(word("w"), pick("s", [" ", ": ", "=", ' "'])), F.concat(pick("s2", [" ", '"', ", "]), word("x")), 1),
        (F.concat(pick("k", ["ghp_", "gho_", "sk_live_", "sk_test_", "glpat-", "npm_", "xoxb-", "AIza"]), F.left(plain, F.lit(24) + r("n", 14).cast("int"))), F.concat(word("w"), pick("s", [" ", ": ", "="])), F.lit(" "), 1),
        (F.left(plain, F.lit(20) + r("n", 30).cast("int")), pick("k", ["password: ", 'secret = "', "api-key=", "token: ", "client_secret='", "pwd = "]), pick("q", ['"', "'", " ", "\n"]), 1),
        (F.concat(F.lit("eyJ"), F.left(plain, F.lit(40)), F.lit("."), F.left(F.reverse(plain), F.lit(30))), pick("k", ["Bearer ", "token=", "jwt: ", "cookie "]), F.lit(" "), 1),
        (F.left(base, F.lit(40)), pick("k", ["aws_secret_access_key = ", "secret_key: ", 'credentials "']), pick("q", [" ", '"', "\n"]), 1),
        (F.left(digits, F.lit(16) + r("n", 4).cast("int")), F.concat(word("w"), pick("k", [" ", " card ", " order ", " phone ", " no. "])), F.concat(pick("e", [" ", ". ", ", "]), word("x")), 0),
        (F.concat(F.lit("mail"), r("m", 99).cast("string"), F.lit("."), word("a"), F.lit("-"), word("b"), pick("t", [".com", ".org", ".net"])), F.concat(made, F.lit("@")), F.lit(" "), 0),
        (F.concat(word("a"), F.lit("-"), word("b"), r("m", 999).cast("string"), F.lit("/"), name, pick("t", [".html", ".png", ".js", ".pdf", "/"])), pick("k", ["see ", "http://", "/", "file "]), F.lit(" "), 0),
        (F.concat(name, F.initcap(word("e")), r("m", 99).cast("string")), F.concat(word("w"), F.lit(" ")), F.concat(pick("q", [" ", "(", ","]), word("x")), 0),
        (F.concat(F.initcap(made), r("m", 9).cast("string")), F.concat(word("w"), F.lit(" ")), F.lit(" "), 0),
        (F.left(hexa, pick("n", [32, 40, 64])), pick("k", ["commit ", "sha256: ", "md5 ", "checksum=", "etag: \"", "digest ", "hash "]), pick("q", [" ", '"', "\n"]), 0),
        (F.concat_ws("-", F.substring(hexa, 1, 8), F.substring(hexa, 9, 4), F.substring(hexa, 13, 4), F.substring(hexa, 17, 4), F.substring(hexa, 21, 12)), pick("k", ["uuid ", "id: ", "guid=", 'id="', "session "]), pick("q", [" ", '"']), 0),
        (F.concat(pick("k", ["password=", "token=", "api_key=", "secret="]), pick("v", ["xxxxxxxxxxxxxxxx", "your_token_here_1", "changeme123456789", "example-key-0123456789", "placeholder000000", "aaaaaaaaaaaaaaaaaaaa1"])), F.concat(word("w"), F.lit(" ")), F.lit(" "), 0),
        (F.concat_ws(".", r("a1", 30).cast("string"), r("a2", 300).cast("string"), r("a3", 3000).cast("string"), F.lit("2024-01-17"), F.lit("rc1")), pick("k", ["version ", "v", "page "]), F.lit(" "), 0),
        (F.left(hexa, F.lit(8) + r("n", 8).cast("int")), pick("k", assign), pick("q", ['"', " ", "\n", ", "]), 1),
        (F.concat(F.lit("a"), F.left(plain, F.lit(4) + r("n", 5).cast("int")), pick("s", ["!", "#", "$", "@", "%", "&", "*", ""]), F.right(plain, F.lit(2) + r("m", 4).cast("int")), r("d", 99).cast("string")), pick("k", assign), pick("q", ['"', " ", "\n", ", "]), 1),
        (F.concat(F.initcap(word("a")), pick("s", ["!", "#", "$", "@", "_"]), F.initcap(word("b")), r("d", 9999).cast("string"), pick("t", ["", "!", "?"])), pick("k", assign), pick("q", ['"', " ", "\n"]), 1),
        (F.left(made, F.lit(18) + r("n", 12).cast("int")), pick("k", assign), pick("q", ['"', " ", "\n", ". "]), 1),
        (F.concat(pick("k", ["AKIA", "ASIA"]), F.left(F.translate(hex_upper, "0123456789", "QWXZJKLMNP"), F.lit(16))), F.concat(word("w"), pick("s", [" ", ": ", "=", ' "'])), F.concat(pick("s2", [" ", '"', ", "]), word("x")), 1),
        (F.left(made, F.lit(6) + r("n", 8).cast("int")), pick("k", [*assign, "key: ", "The key: ", "pass: "]), F.concat(pick("q", [" ", ", ", ". "]), word("x")), 0),
        (F.concat(word("a"), pick("s", ["_", "-", ".", "/", ""]), word("b"), pick("t", ["", "", "()", "[0]", "s"])), pick("k", [*assign, "key: ", "pass: "]), F.concat(pick("q", [" ", ", ", ". ", "\n"]), word("x")), 0),
        (F.concat(pick("s", ["${", "{{", "<", "$", "%", "["]), F.when(r("u", 2) == 0, F.upper(word("a"))).otherwise(word("a")), F.lit("_"), word("b"), pick("t", ["}", "}}", ">", "", "%", "]"])), pick("k", assign), pick("q", ['"', " ", "\n"]), 0),
        (F.concat(word("a"), F.initcap(F.left(made, F.lit(3) + r("n", 8).cast("int"))), F.when(r("u", 2) == 0, F.initcap(word("b"))).otherwise(""), F.initcap(word("c")), F.initcap(word("d")), pick("t", ["", "", "2", "64", "V3"])), pick("k", ["function ", "call ", "new ", "use ", "the ", "= ", "class "]), pick("q", ["(", " ", ".", ";", "\n"]), 0),
        (F.concat(F.initcap(F.when(r("v", 2) == 0, F.left(made, F.lit(6) + r("n", 9).cast("int"))).otherwise(word("a"))), (r("d", 9990) + 10).cast("string"), pick("t", ["", "!", "?", "."])), pick("k", assign), pick("q", ['"', " ", "\n"]), 1),
        (F.left(plain, F.lit(8) + r("n", 12).cast("int")), address, host, 1),
        (F.concat(F.left(F.lower(plain), F.lit(3) + r("n", 5).cast("int")), r("d", 999).cast("string"), F.right(F.lower(plain), r("m", 4).cast("int"))), address, host, 1),
        (F.concat(F.initcap(F.left(made, F.lit(5) + r("n", 7).cast("int"))), r("d", 9999).cast("string"), pick("t", ["", "!", "$"])), address, host, 1),
        (F.concat(pick("v", ["password", "pass", "pwd", "secret", "xxxxx", "changeme", "${DB_PASS}", "$PASSWORD", "your_password", "user", "example", "{{pw}}", "%s", "*****"]), F.lit("")), address, host, 0),
    ]
    kind = r("kind", len(kinds))
    options = [F.when(kind == k, F.struct(c.alias("candidate"), b.alias("before"), a.alias("after"), F.lit(y).alias("label"))) for k, (c, b, a, y) in enumerate(kinds)]
    return spark.range(rows).select(F.coalesce(*options).alias("x")).select("x.*")


def _literal(values: list, kind: str) -> Column:
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


def _bin(value: Column, edges: list[float]) -> Column:
    """How many of the edges lie below the value."""
    return F.size(F.filter(_literal(edges, "double"), lambda c: c < value)) if edges else F.lit(0)


class Forest:
    """Trees in arrays of NODES each: the feature a node tests (-1: a leaf), where it cuts, and its
    share of label 1. Node k's children are 2k + 1 (up to the cut) and 2k + 2."""

    def __init__(self, feature: list[int], cut: list[float], share: list[float]):
        self.feature, self.cut, self.share = feature, cut, share

    def node(self, x: Column, tree: Column, depth: int) -> Column:
        feature, cut = _literal(self.feature, "int"), _literal(self.cut, "double")

        def step(node: Column, _: Column) -> Column:
            at = tree * NODES + node
            f = F.get(feature, at)
            return F.when(f < 0, node).otherwise(2 * node + 1 + (F.get(x, f) > F.get(cut, at)).cast("int"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step) if depth else F.lit(0)

    def score(self, x: Column) -> Column:
        """The mean share over the trees; the features are computed once."""
        share = _literal(self.share, "double")
        trees = F.sequence(F.lit(0), F.lit(len(self.share) // NODES - 1))
        total = lambda v: F.aggregate(trees, F.lit(0.0), lambda a, t: a + F.get(share, t * NODES + self.node(v, t, DEPTH)))
        return F.get(F.transform(F.array(x), total), 0) / (len(self.share) // NODES)


def train(findings: DataFrame, rows: int = TRAIN_ROWS, seed: int = SEED, dictionary: list[str] = ()) -> Forest:
    """A forest from findings (candidate, before, after, label): at most ``rows`` of them, those with
    the smallest hashes. Each tree weighs rows by a hashed Poisson draw and tries, at each node,
    a random third of the features at quantile cuts; Gini impurity decides."""
    text = [F.coalesce(F.col(c), F.lit("")) for c in ("candidate", "before", "after")]
    order = F.xxhash64(*text, "label")
    sample = findings.where(F.col("label").isin(0, 1)).orderBy(order).limit(rows).select(features(*text, dictionary).alias("x"), F.col("label").cast("int").alias("y"), order.alias("h"))
    sample = save(sample, "secret-findings")
    cuts = sample.select(*[F.percentile_approx(F.get("x", F.lit(j)), [k / BINS for k in range(1, BINS)], 10_000).alias(f"c{j}") for j in range(FEATURES)]).first()
    edges = [sorted(set(c or [])) for c in cuts]
    n, pos = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    forest = Forest([-1] * (TREES * NODES), [0.0] * (TREES * NODES), [pos / n if n else 0.0] * (TREES * NODES))
    draw = F.pmod(F.xxhash64("h", "tree", F.lit(seed)), F.lit(10_000)) / 10_000
    weight = F.when(draw < 0.3679, 0).when(draw < 0.7358, 1).when(draw < 0.9197, 2).when(draw < 0.981, 3).otherwise(4)
    bins = F.array(*[_bin(F.get("x", F.lit(j)), e) for j, e in enumerate(edges)])
    each = sample.select("x", "y", "h", bins.alias("bins")).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).withColumn("w", weight).where("w > 0")
    each = save(each.select("tree", "w", "y", "x", "bins"), "secret-bins")
    rng = random.Random(seed)
    for depth in range(DEPTH + 1):
        at = each.withColumn("node", forest.node(F.col("x"), F.col("tree"), depth)).where(F.col("node") >= 2**depth - 1)
        # as many rows as trees, nodes, features and bins allow
        table = at.select("tree", "node", "w", "y", F.posexplode("bins").alias("j", "bin")).groupBy("tree", "node", "j", "bin").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("p")).collect()
        grown: dict = {}
        for r in table:
            grown.setdefault((r["tree"], r["node"]), {}).setdefault(r["j"], {})[r["bin"]] = (r["n"], r["p"])
        for (tree, node), by_feature in sorted(grown.items()):
            total = [sum(v) for v in zip(*by_feature[0].values(), strict=True)]
            forest.share[tree * NODES + node] = (total[1] + 0.5) / (total[0] + 1)
            if depth == DEPTH or total[1] in (0, total[0]):
                continue
            best = (1e-9, None)
            for j in rng.sample(range(FEATURES), max(1, FEATURES // 3)):
                left_n = left_p = 0
                for b in range(len(edges[j])):
                    n_b, p_b = by_feature[j].get(b, (0, 0))
                    left_n, left_p = left_n + n_b, left_p + p_b
                    right_n, right_p = total[0] - left_n, total[1] - left_p
                    if min(left_n, right_n) >= LEAST:
                        gain = left_p**2 / left_n + (left_n - left_p) ** 2 / left_n + right_p**2 / right_n + (right_n - right_p) ** 2 / right_n - (total[1] ** 2 + (total[0] - total[1]) ** 2) / total[0]
                        best = max(best, (gain, (j, edges[j][b])), key=lambda x: x[0])
            if best[1]:
                forest.feature[tree * NODES + node], forest.cut[tree * NODES + node] = best[1]
    forget(sample, each)
    return forest


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every candidate of every text (see candidates()) with the forest's score: doc_id, nth, start, candidate,
    before, after, score (0 to 1) and secret (score >= ``threshold``). ``findings`` are labelled
    ones to learn from; labelled_findings() unless given. What counts as a word comes from the corpus
    itself, see frequent_words(), and from WORDS.

    Null or empty texts have no candidates; long texts are read whole. Null ids stay null, repeated
    rows repeat theirs. Findings with null parts count them as empty; labels other than 0 and 1
    are left out; without findings every score is 0. Empty table: no rows. Other columns are not
    read.
    """
    dictionary = sorted({*frequent_words(docs, text_col), *WORDS})
    if findings is None:
        findings = labelled_findings(docs.sparkSession)
    forest = train(findings, train_rows, dictionary=dictionary)
    rows = candidates(docs, id_col, text_col)
    score = forest.score(features(F.col("candidate"), F.col("before"), F.col("after"), dictionary))
    return rows.withColumn("score", score).select(F.col("id").alias("doc_id"), "nth", "start", "candidate", "before", "after", "score", (F.col("score") >= threshold).alias("secret"))
