"""URL filters with DataFrame functions and Spark's FP-growth: fixed rules first, mined association rules for the rest.

Pages whose url a fixed rule decides are the labelled ones. FP-growth mines which combinations of url tokens go with a
verdict; rules with enough support and confidence are kept, and only those that add confidence over each shorter one,
the rule without items included: its confidence is the verdict's share of all labelled pages. They match through an
inverted index: each rule is listed under its rarest item, a page's tokens look rules up, and a rule fires where all its
items are among them. The most confident firing rule gives the verdict (of equals the longest, then the one that adds
most to its verdict's share), without one it is to allow.

FP-growth lists every frequent itemset, 2^k of them for k tokens that come together. So what it gets is thinned first,
by steps that lose no rule which pruning would keep: tokens too rare for any rule go; of tokens that lie on the same
labelled pages one is mined and the others stand beside it in its rules, where any of them will do; and a token whose
pages all have one verdict is mined by itself, as nothing can gain over it. What is left of a page is one transaction.

FP-growth gets those of at most `together` tokens, at most 2^together / support itemsets. Combinations that also lie on
pages with more are looked for a token at a time over all pages, and go on only where pruning may keep what comes of
them (`levels`). Both ways find all of their rules, whose supports and confidences are then counted over all labelled pages.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import cut, drop_cut

# The rules of the contract (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Mining:
    """Limits of the mined rules (lift_over_shorter above 0). together: pages with more tokens after thinning are mined by
    levels; it decides the way, not the rules. max_items: None takes pages whole. With a number, FP-growth alone gets only so
    many tokens of a page, those nearest to a verdict, for a caller who would rather miss combinations than wait for them."""

    support: float = 0.01
    confidence: float = 0.9
    lift_over_shorter: float = 0.02
    together: int = 10
    max_items: int | None = None
    partitions: int = 32


def rest(url: Column) -> Column:
    """What follows the first ://; empty if there is none or the url is null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(rest(url), r"^[^/?#]*([^?#]*)", 1)


def fixed(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """A struct (rule, verdict) of the longest fixed rule that fits, or null."""
    out = F.lit(None)
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(host: Column, path: Column, query: Column) -> Column:
    """Distinct tokens of a url: labels of the host by place, segments of the path without digits, names of query fields."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    last = F.transform(F.slice(F.reverse(labels), 1, 3), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    first = F.transform(F.slice(labels, 1, 1), lambda x: F.concat(F.lit("sub:"), x))
    words = F.filter(F.split(F.lower(path), r"[^\p{L}]+"), lambda x: x != "")
    segments = F.transform(words, lambda x: F.concat(F.lit("p:"), x))
    ends = F.when(path.rlike(r"[0-9]/$"), F.array(F.lit("end:/"))).otherwise(F.array().cast("array<string>"))
    fields = F.transform(F.filter(F.regexp_extract_all(query, F.lit(r"([A-Za-z_]+)="), F.lit(1)), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), x))
    return F.array_distinct(F.concat(last, first, segments, ends, fields))


def thinned(sets: DataFrame, n: int, m: Mining) -> DataFrame:
    """(token, alike, strong, near) of the tokens that FP-growth gets, from the distinct (tokens, verdict) with their `pages`,
    n in all: those of which some verdict has enough support and that are not on all pages. `alike`: the tokens on the
    same pages, of which the smallest is the token. `strong`: all of its pages have one verdict, so that no rule adds to
    it. `near`: its largest share of one verdict."""
    each = sets.select(F.explode("tokens").alias("token"), "verdict", "pages", F.xxhash64("tokens", "verdict").alias("h"))
    # Two sums over hashes of the sets that hold it tell which tokens are in the same ones.
    by = each.groupBy("token", "verdict").agg(F.sum("pages").alias("c"), F.bit_xor("h").alias("x"), F.sum(F.xxhash64("h") % (1 << 40)).alias("s"))
    enough = F.col("c") >= m.support * n - 1e-9
    by = by.groupBy("token").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.sum(enough.cast("int")).alias("verdicts"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"))
    one = by.where((F.col("verdicts") > 0) & (F.col("n") < n)).groupBy("n", "x", "s")
    one = one.agg(F.min(F.struct("token", "most", "verdicts")).alias("t"), F.array_sort(F.collect_list("token")).alias("alike"))
    return one.select("t.token", "alike", (F.col("t.most") == F.col("n")).alias("strong"), (F.col("t.most") / F.col("n")).alias("near"))


def transactions(sets: DataFrame, chosen: DataFrame, m: Mining) -> DataFrame:
    """(items, verdict, pages): of each set the tokens that may combine, all unless max_items is given, and each strong
    token by itself."""
    tagged = sets.select("tokens", "verdict", "pages", F.explode("tokens").alias("token"))
    tagged = tagged.join(F.broadcast(chosen), "token")  # a token needs support * pages of them: at most tokens of a page / support rows
    place = F.struct((-F.col("near")).alias("far"), "token")
    mixed = tagged.where("not strong").groupBy("tokens", "verdict", "pages").agg(F.array_sort(F.collect_list(place)).alias("t"))
    if m.max_items is not None:
        mixed = mixed.withColumn("t", F.slice("t", 1, m.max_items))
    both = mixed.select(F.col("t.token").alias("items"), "verdict", "pages").unionByName(tagged.where("strong").select(F.array("token").alias("items"), "verdict", "pages"))
    return both.groupBy(F.array_sort("items").alias("items"), "verdict").agg(F.sum("pages").alias("pages"))


def repeated(given: DataFrame, step: int = 10_000) -> DataFrame:
    """(items) as often as `pages` says, in two steps, so that a set of a third of all pages is no long array in one task."""
    parts = given.select("items", "pages", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("pages") - 1) / step))).alias("k"))
    parts = parts.select("items", F.least(F.lit(step).cast("long"), F.col("pages") - F.col("k") * step).alias("n")).repartition("items", "n", F.rand(1))
    return parts.select("items", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("items")


def bits(items: str, n: int) -> list[Column]:
    """A set of numbers below n as longs, bit by bit: one holds another where each of its longs does."""
    each = "aggregate({0}, 0L, (a, i) -> if(i div 64 = {1}, a | shiftleft(1L, i % 64), a))"
    return [F.expr(each.format(items, k)) for k in range(-(-n // 64))]


def numbered(sets: DataFrame, chosen: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """One row (words) of the chosen tokens, of which a token's number is the place; how many there are, at most tokens of a
    page / support; and of the sets (tokens, verdict, pages) their chosen tokens as numbers, which `size` counts without strong ones."""
    words = chosen.agg(F.array_sort(F.collect_list("token")).alias("words"), F.collect_list(F.expr("if(strong, null, token)")).alias("mixed"))
    words = cut(words, "url-words")
    n = words.select(F.size("words")).first()[0]
    numbers = F.expr("transform(array_intersect(tokens, words), x -> cast(array_position(words, x) - 1 as int))")
    held = sets.crossJoin(F.broadcast(words)).select(numbers.alias("tokens"), F.size(F.array_intersect("tokens", "mixed")).alias("size"), "verdict", "pages")
    held = held.where(F.size("tokens") > 0).groupBy("tokens", "size", "verdict").agg(F.sum("pages").alias("pages"))
    return words.select("words"), n, cut(held.select("*", *[x.alias(f"has{i}") for i, x in enumerate(bits("tokens", n))]), "url-held")


def counted(held: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """(items, verdict, c, longest): the pages of each verdict that hold distinct (items) of n numbers, and the largest `size` of them."""
    index = listed(items.select("items", F.transform("items", lambda x: F.array(x)).alias("alike")))
    index = index.select("items", "token", *[x.alias(f"own{i}") for i, x in enumerate(bits("items", n))])
    holds = reduce(lambda x, y: x & y, [F.col(f"has{i}").bitwiseAND(F.col(f"own{i}")) == F.col(f"own{i}") for i in range(-(-n // 64))])
    found = held.select("*", F.explode("tokens").alias("token")).join(index, "token").where(holds)
    return found.groupBy("items", "verdict").agg(F.sum("pages").alias("c"), F.max("size").alias("longest"))


def levels(held: DataFrame, of_verdict: DataFrame, n: int, w: int, m: Mining) -> DataFrame:
    """(items, verdict) of all combinations of w numbers, on some set of a size over `together`, that may be rules which pruning keeps.

    One token more at a time. A combination goes on for a verdict only with enough support, and if each of its tokens
    leaves out a page of other verdicts that the rest of it holds. Without that, neither it nor a longer one has more
    confidence than the same without that token, so that pruning drops both. What goes on has only parts that do.
    """
    first = held.where(F.col("size") > m.together).select(F.explode("tokens").alias("token")).distinct()
    # least: the fewest pages of other verdicts that a part of it holds, the one without tokens first.
    tried = first.select(F.array("token").alias("items")).crossJoin(F.broadcast(of_verdict.select("verdict", (n - F.col("of_verdict")).alias("least"))))
    tried, found, k = cut(tried, "url-tried"), [], 1
    while True:
        counts = counted(held, tried.select("items").distinct(), w).groupBy("items").agg(F.sum("c").alias("all"), F.max("longest").alias("longest"), F.collect_list(F.struct("verdict", "c")).alias("v"))
        counts = counts.where(F.col("longest") > m.together).select("items", "all", F.inline("v")).where(F.col("c") >= m.support * n - 1e-9)
        alive = counts.join(tried, ["items", "verdict"]).select("items", "verdict", (F.col("all") - F.col("c")).alias("others"), (F.col("c") / F.col("all")).alias("confidence"), "least")
        alive = cut(alive.where("others < least").drop("least"), "url-level")
        drop_cut(tried)
        found.append(alive.where(F.col("confidence") >= m.confidence - 1e-12).select("items", "verdict"))
        on = alive.where("others > 0")
        if on.isEmpty():
            break
        ends = on.select("verdict", F.slice("items", 1, k - 1).alias("head"), F.element_at("items", -1).alias("last"))
        pairs = ends.join(ends.withColumnRenamed("last", "next"), ["verdict", "head"]).where("last < next")
        pairs = pairs.select("verdict", F.concat("head", F.array("last", "next")).alias("items"))
        parts = pairs.select("verdict", "items", F.explode(F.transform("items", lambda x: F.array_except("items", F.array(x)))).alias("part"))
        parts = parts.join(on.select("verdict", F.col("items").alias("part"), "others"), ["verdict", "part"])
        parts = parts.groupBy("verdict", "items").agg(F.count("*").alias("parts"), F.min("others").alias("least"))
        tried, k = cut(parts.where(F.col("parts") == k + 1).select("items", "verdict", "least"), "url-tried"), k + 1
    return reduce(DataFrame.unionByName, found)


def grown(given: DataFrame, n: int, total: int, confidence: float, m: Mining) -> DataFrame:
    """(items, verdict) of the combinations that FP-growth finds in transactions (items, verdict, pages) of `total` pages: those with
    one verdict on at least support * n pages and with that confidence."""
    # A page may give several transactions, so the least support is that of pages as a share of transactions.
    rows = given.select(F.concat("items", F.array(F.concat(F.lit("verdict="), "verdict"))).alias("items"), "pages")
    fit = FPGrowth(itemsCol="items", minSupport=min(1.0, m.support * n / total * (1 - 1e-9)), minConfidence=confidence * (1 - 1e-9), numPartitions=m.partitions).fit(repeated(rows))
    found = fit.associationRules.where((F.size("consequent") == 1) & F.element_at("consequent", 1).startswith("verdict=") & ~F.exists("antecedent", lambda x: x.startswith("verdict=")))
    return found.select(F.array_sort("antecedent").alias("items"), F.expr("substr(element_at(consequent, 1), 9)").alias("verdict"))


def mine(labelled: DataFrame, m: Mining = Mining()) -> DataFrame:
    """Rules (items, alike, verdict, confidence, support, gain over the verdict's share of all rows) from (tokens, verdict).

    Rows with a null verdict or null tokens don't count; a token counts once a row. Without rows there are no rules.
    alike: for each item the tokens on the same rows as it, the smallest of which the item is. A token on every row is in
    no rule, as it adds nothing.
    """
    rows = labelled.where("verdict is not null and tokens is not null").select(F.array_sort(F.array_distinct("tokens")).alias("tokens"), "verdict")
    sets = cut(rows.groupBy("tokens", "verdict").agg(F.count("*").alias("pages")), "url-sets")
    n = sets.agg(F.sum("pages")).first()[0] or 0
    chosen = cut(thinned(sets, n, m), "url-tokens")
    given = cut(transactions(sets, chosen, m), "url-transactions")
    of_verdict = sets.groupBy("verdict").agg(F.sum("pages").alias("of_verdict"))
    few = F.size("items") <= m.together if m.max_items is None else F.lit(True)
    total, rest = given.agg(F.sum(F.when(few, F.col("pages"))), F.count(F.when(~few, 1))).first()
    if not total and not rest:
        return labelled.sparkSession.createDataFrame([], "items array<string>, alike array<array<string>>, verdict string, confidence double, support double, gain double")
    words, w, held = numbered(sets, chosen)
    ways = []
    if total:
        # What is found is counted again over all pages. Where FP-growth doesn't get them all, its confidences say nothing.
        got = grown(given.where(few), n, total, 0.0 if rest else m.confidence, m).crossJoin(F.broadcast(words))
        ways.append(got.select(F.expr("transform(items, x -> cast(array_position(words, x) - 1 as int))").alias("items"), "verdict"))
    if rest:
        ways.append(levels(held, of_verdict, n, w, m))
    found = cut(reduce(DataFrame.unionByName, ways).distinct(), "url-found")
    # On labelled pages those alike come together, so that each page meets a rule once under the item itself.
    counts = counted(held, found.select("items").distinct(), w)
    whole = counts.groupBy("items").agg(F.sum("c").alias("all"))
    confidence = F.col("c") / F.col("all")
    exact = counts.join(whole, "items").join(of_verdict, "verdict").join(found, ["items", "verdict"]).select("items", "verdict", confidence.alias("confidence"), (F.col("c") / n).alias("support"), (confidence - F.col("of_verdict") / n).alias("gain"))
    exact = exact.where((F.col("support") >= m.support - 1e-12) & (F.col("confidence") >= m.confidence - 1e-12))
    exact = cut(exact.crossJoin(F.broadcast(words)).withColumn("items", F.expr("transform(items, i -> words[i])")).drop("words"), "url-exact")
    own = exact.select("items").distinct().select("items", F.posexplode("items").alias("i", "token"))
    own = own.join(F.broadcast(chosen.select("token", "alike")), "token").groupBy("items").agg(F.array_sort(F.collect_list(F.struct("i", "alike"))).alias("a"))
    return exact.join(own.select("items", F.col("a.alike").alias("alike")), "items").select("items", "alike", "verdict", "confidence", "support", "gain")


def listed(rules: DataFrame) -> DataFrame:
    """The inverted index: each rule under the one of its items that the fewest rules hold (of equals the smallest), that is
    under each token that will do for it."""
    each = rules.select("items", F.explode("items").alias("token"))
    held = each.groupBy("token").agg(F.count("*").alias("held"))
    key = each.join(held, "token").groupBy("items").agg(F.min(F.struct("held", "token")).alias("k"))
    own = F.element_at("alike", F.array_position("items", F.col("k.token")).cast("int"))
    return rules.join(key, "items").select(*rules.columns, F.explode(own).alias("token"))


def met(sets: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of sets (tokens, ...) with each rule of the index of which they hold all items, or tokens alike. A rule comes
    once for each token that it is listed under and the set holds."""
    found = sets.select("*", F.explode("tokens").alias("token")).join(index, "token")
    return found.where(F.forall("alike", lambda x: F.arrays_overlap(x, F.col("tokens")))).drop("token", "alike")


def prune(rules: DataFrame, m: Mining = Mining()) -> DataFrame:
    """Rules that add at least `lift_over_shorter` of confidence to their verdict's share of all rows, and to each rule on
    all their items but one: a rule as good on a part of them, or nearly so, stands for the longer one."""
    longer = rules.select("items", "verdict", "confidence", F.explode(F.transform(F.sequence(F.lit(1), F.size("items")), lambda i: F.array_except("items", F.array(F.element_at("items", i))))).alias("part"))
    part = rules.select(F.col("items").alias("part"), "verdict", F.col("confidence").alias("less"))
    beaten = longer.join(part, ["part", "verdict"]).where(F.col("confidence") < F.col("less") + m.lift_over_shorter).select("items", "verdict").distinct()
    return rules.where(F.col("gain") >= m.lift_over_shorter).join(beaten, ["items", "verdict"], "left_anti")


def judge(pages: DataFrame, m: Mining = Mining(), rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: id, host, path, rule (null if none fits), verdict, and the mined rule's confidence.

    Null urls and those without :// have empty host and path and are allowed. Pages with one and the same set of tokens
    are matched once; the match comes back by a join on that set, so a hot host is one row of the match.
    """
    url = F.col(url_col).cast("string")
    df = pages.select(F.col(id_col), host(url).alias("host"), path(url).alias("path"), F.regexp_extract(rest(url), r"\?([^#]*)", 1).alias("query"))
    df = df.select(id_col, "host", "path", fixed(F.col("host"), F.col("path"), rules).alias("fixed"), tokens(F.col("host"), F.col("path"), F.col("query")).alias("tokens"))
    labelled = df.where("fixed is not null").select("tokens", F.col("fixed.verdict").alias("verdict"))
    mined = cut(prune(cut(mine(labelled, m), "url-mined"), m), "url-rules").withColumnRenamed("verdict", "mined")
    free = df.groupBy("tokens").agg(F.count("*").alias("pages"), F.count("fixed").alias("labelled")).where("labelled < pages").select("tokens")
    order = F.struct("confidence", F.size("items").alias("size"), "gain", F.col("mined").alias("verdict"))
    best = met(free, listed(mined)).groupBy("tokens").agg(F.max(order).alias("best"))
    out = df.join(best, "tokens", "left")
    verdict = F.coalesce(F.col("fixed.verdict"), F.col("best.verdict"), F.lit("allow"))
    return out.select(id_col, "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("fixed").isNull(), F.col("best.confidence")).alias("confidence"))
