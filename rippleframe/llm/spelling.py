"""Grouping of spelling variants by a relational trie frontier.

Frequent words are spread into two tries, one of the words and one of the reversed words, as
tables of nodes. A node is the name of a prefix and holds its outgoing edges, one per letter: the
child, the word that alone goes through it (if one does), which numbers of letters are still
to come below it and which letters may come next. The frontier is a table of states (word,
position, node, edits). A word's own path is known, so its states without an edit are
written at once; a join with the nodes gives each its edits: another edge in place of the
letter, or the letter left out. From there states with one edit move by joins on
their next letter, level by level, until their path holds a single word or ends. Terminal states
are neighbours.

An edit in the second half of a word is looked for in the trie, one in the first half in the
trie of reversed words: paths share half a word before they part, so nodes have few edges
and a state few ways to go. Each pair is reached from one side only (the greater letter; the
shorter word), so states stay few.

No state is compared with another, and no cell of words is paired: work follows the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.session import durable

#: Letters of words: ASCII and U+00C0 to U+00FF.
LETTERS = "[A-Za-zÀ-ÿ]+"
MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
#: Prefixes and rests below this length are their own names; of longer ones the MD5 stands for them.
NAMED = 32
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def name(text: Column) -> Column:
    """A key of bounded size for a text: itself, or 32 hex digits, so the two never meet."""
    return F.when(F.length(text) < NAMED, text).otherwise(F.md5(text.cast("binary")))


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and all other letters as they are."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def letter_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, word) of every maximal run of letters of every text, ASCII letters in lower case; a null text has none."""
    runs = docs.select(F.col(key), F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(LETTERS), F.lit(0))).alias("__run"))
    return runs.select(F.col(key), lower_ascii(F.col("__run")).alias("word"))


def frequent_words(runs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of enough letters that occur often enough; null words do not count."""
    counted = runs.where(F.length("word") >= min_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


def _length_bit(rest: Column) -> Column:
    return _bit(F.least(rest, F.lit(63)))


def _letter_bit(letter: Column) -> Column:
    return _bit(F.pmod(F.hash(letter), F.lit(64)))


def _letter(at: Column) -> Column:
    """The letter of ``spelled`` at a position from 0; empty past the end."""
    return F.substring(F.col("spelled"), at + 1, F.lit(1))


def _rest(at: Column) -> Column:
    return F.substring(F.col("spelled"), at + 1, F.col("letters"))


def _places(words: DataFrame) -> DataFrame:
    """A row for each place in the second half of each word and of each reversed word, with the letters there."""
    own = words.select(name(F.col("word")).alias("id"), F.length("word").alias("letters"), F.col("word").alias("w"))
    sides = F.array(F.struct(F.lit("0").alias("side"), F.col("w").alias("spelled")), F.struct(F.lit("1").alias("side"), F.reverse("w").alias("spelled")))
    both = own.select("id", "letters", F.explode(sides).alias("s")).select("id", "letters", "s.side", "s.spelled")
    half = F.floor(F.col("letters") / 2).cast("int")
    first = F.when(F.col("side") == "0", half).otherwise(F.col("letters") - half)
    return both.select("*", F.explode(F.sequence(first, F.col("letters") - 1)).alias("i"))


def _prefix(upto: Column) -> Column:
    return name(F.concat("side", F.substring(F.col("spelled"), F.lit(1), upto)))


def trie(words: DataFrame) -> DataFrame:
    """node and kids (its edges) of every node that two words or more go through.

    An edge has its letter, child, n (words that go on below the child), id and rest (of the
    smallest such word; of use where n is 1), end (the word that ends at the child), lengths
    and next (bit sets: letters to come below the child, letters that may follow).
    """
    i = F.col("i")
    rest = F.col("letters") - i - 1
    edges = _places(words).select(
        _prefix(i).alias("node"), _letter(i).alias("letter"), _prefix(i + 1).alias("child"), F.when(rest > 0, F.col("id")).alias("id"), F.when(rest > 0, name(_rest(i + 1))).alias("rest"),
        F.when(rest == 0, F.col("id")).alias("end"), _length_bit(rest).alias("lengths"), F.when(rest > 0, _letter_bit(_letter(i + 1))).alias("next"),
    )
    edges = edges.groupBy("node", "letter").agg(
        F.min("child").alias("child"), F.count("id").alias("n"), F.count(F.lit(1)).alias("through"), F.min("id").alias("id"), F.min("rest").alias("rest"), F.max("end").alias("end"),
        F.bit_or("lengths").alias("lengths"), F.coalesce(F.bit_or("next"), F.lit(0).cast("long")).alias("next"),
    )
    # At most one edge per letter of the alphabet.
    kids = F.collect_list(F.struct("letter", "child", "n", "id", "rest", "end", "lengths", "next")).alias("kids")
    return edges.groupBy("node").agg(kids, F.sum("through").alias("through")).where("through > 1").drop("through")


def _steps(kids: Column, letter, to_come: Column, following: Column, rest: Column) -> Column:
    """The edges a state can take, as structs (node, id, rest, to_come): ``id`` is the word reached, null if the walk goes on.

    ``letter`` says whether an edge is allowed; ``to_come`` letters must follow it, ``following`` first, which are named ``rest``.
    """

    def alive(k: Column) -> Column:
        goes_on = k["lengths"].bitwiseAND(_length_bit(to_come)) != 0
        next_fits = (to_come == 0) | (k["next"].bitwiseAND(_letter_bit(following)) != 0)
        single_fits = (to_come == 0) | (k["n"] > 1) | (k["rest"] == rest)
        return letter(k) & goes_on & next_fits & single_fits

    def taken(k: Column) -> Column:
        reached = F.when(to_come == 0, k["end"]).when(k["n"] == 1, k["id"])
        return F.struct(k["child"].alias("node"), reached.alias("near"), rest.alias("rest"), to_come.alias("to_come"))

    return F.transform(F.filter(kids, alive), taken)


def _edited(words: DataFrame, nodes: DataFrame) -> DataFrame:
    """States after one edit: (id, side, node, near, rest, to_come)."""
    i, c0, c1 = F.col("i"), F.col("c0"), F.col("c1")
    states = _places(words).select(
        "id", "side", _prefix(i).alias("__node"), _letter(i).alias("c0"), _letter(i + 1).alias("c1"), _letter(i + 2).alias("c2"),
        name(_rest(i + 1)).alias("rest1"), name(_rest(i + 2)).alias("rest2"), (F.col("letters") - i - 1).alias("after"),
    )
    met = states.join(nodes, states["__node"] == nodes["node"]).drop("node")
    replaced = _steps(F.col("kids"), lambda k: k["letter"] > c0, F.col("after"), c1, F.col("rest1"))
    # Of a run of equal letters the last is left out.
    left_out = _steps(F.col("kids"), lambda k: (k["letter"] == c1) & (c1 != c0), F.col("after") - 1, F.col("c2"), F.col("rest2"))
    return met.select("id", "side", F.explode(F.concat(replaced, left_out)).alias("s")).select("id", "side", "s.*")


def neighbours(words: DataFrame) -> DataFrame:
    """(a, b), the names of each pair of words of ``words`` (word, n) that differ by one inserted, deleted or replaced letter, once.

    Words must be distinct. Runs a job per level; levels end when no state is left.
    """
    nodes = durable(trie(words), "trie")
    frontier = durable(_edited(words, nodes), "frontier")
    # A word without its last letter needs no walk: it is a word or not.
    shorter = words.where(F.length("word") > 1).select(name(F.col("word")).alias("id"), name(F.substring(F.col("word"), F.lit(1), F.length("word") - 1)).alias("near"))
    without_first = words.where(F.length("word") > 1).select(name(F.col("word")).alias("id"), name(F.substring(F.col("word"), 2, F.length("word"))).alias("near"))
    found = [shorter, without_first]
    while True:
        found.append(frontier.where(F.col("near").isNotNull()).select("id", "near"))
        open_states = frontier.where(F.col("near").isNull())
        if open_states.isEmpty():
            break
        frontier = durable(_walked(open_states, words, nodes), "frontier")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs.distinct().select(F.col("id").alias("a"), F.col("near").alias("b"))


def _walked(states: DataFrame, words: DataFrame, nodes: DataFrame) -> DataFrame:
    """The states one level on."""
    own = words.select(name(F.col("word")).alias("__id"), F.col("word").alias("__w"))
    # Short rests are their own names; a long one is cut from its word again.
    short, long = states.where(F.col("to_come") < NAMED), states.where(F.col("to_come") >= NAMED)
    spelled = F.when(F.col("side") == "0", F.col("__w")).otherwise(F.reverse("__w"))
    long = long.join(own, long["id"] == own["__id"]).withColumn("rest", F.substring(spelled, F.length("__w") - F.col("to_come") + 1, F.col("to_come")))
    at = short.unionByName(long.select(*short.columns)).withColumnRenamed("node", "__node")
    met = at.drop("near").join(nodes, at["__node"] == nodes["node"]).drop("node", "__node")
    letter, following, rest = (F.substring(F.col("rest"), F.lit(k), n) for k, n in ((1, F.lit(1)), (2, F.lit(1)), (2, F.length("rest"))))
    moved = met.select("id", "side", "kids", letter.alias("c0"), following.alias("c1"), name(rest).alias("rest1"), (F.col("to_come") - 1).alias("after"))
    step = _steps(F.col("kids"), lambda k: k["letter"] == F.col("c0"), F.col("after"), F.col("c1"), F.col("rest1"))
    return moved.select("id", "side", F.explode(step).alias("s")).select("id", "side", "s.*")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that the forms (word, form) lead to; forms hold no circle. Each round doubles the steps."""
    reach = durable(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = reach.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        if reach.join(on, reach["root"] == on["__w"], "left_semi").isEmpty():
            return reach
        reach = durable(reach.join(on, reach["root"] == on["__w"], "left").select("word", F.coalesce("__r", "root").alias("root")), "forms")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of ``words`` (word, n).

    Near words differ by one inserted, deleted or replaced code point; n_near counts them.
    A word's form is its near word of largest n (of equals the smallest in code-point order) if that n
    is at least ``ratio`` times the word's, else null, as form_n then is. The root is
    the last word that forms lead to, the word itself if it has none. Words are
    distinct and not null, as ``frequent_words`` gives them; other columns are ignored. An
    empty table gives an empty result. Runs jobs and stores tables in the checkpoint folder.
    """
    words = durable(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = neighbours(words)
    first = words.select(name(F.col("word")).alias("__a"), F.col("word").alias("wa"), F.col("n").alias("na"))
    second = words.select(name(F.col("word")).alias("__b"), F.col("word").alias("wb"), F.col("n").alias("nb"))
    known = pairs.join(first, pairs["a"] == first["__a"]).join(second, pairs["b"] == second["__b"])
    known = known.where(F.levenshtein("wa", "wb", 1) == 1).select("wa", "na", "wb", "nb")
    sides = F.array(F.struct(F.col("wa").alias("w"), F.col("wb").alias("near"), F.col("nb").alias("n")), F.struct(F.col("wb").alias("w"), F.col("wa").alias("near"), F.col("na").alias("n")))
    near = known.select(F.explode(sides).alias("s")).select("s.*")
    best = near.groupBy("w").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    own = words.join(best, words["word"] == best["w"], "left").drop("w")
    formed = -F.col("best.less") >= ratio * F.col("n")
    own = durable(own.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")), "near")
    roots = _roots(own.where(F.col("form").isNotNull())).withColumnRenamed("word", "__w")
    out = own.join(roots, own["word"] == roots["__w"], "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
