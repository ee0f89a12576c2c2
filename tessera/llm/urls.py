"""10. URL filters: host and path rules, then a ratio of two character language models.  No Python on the rows.

Rules name a host (it and its subdomains) and the start of a path; the longest fitting rule decides
(host and path characters together; at a tie the rule that is first in order of `host/path`).

Urls that no rule fits are judged by two variable-order Markov models, one of the urls that rules accept, one of those that
rules reject.  Characters are folded to 64 symbols, so a context of up to ORDER symbols is one of a fixed number of cells whatever the
input; longer contexts are smoothed by shorter ones (counts plus SMOOTH times the shorter context's
probability).  The models meet in one row, an array of log ratios of 64 ** (ORDER + 1) numbers.  A url's score is the mean log
ratio of its characters; the cut is where errors on accepted and rejected urls add up to least, among urls that the models haven't counted (every fifth
id; with too few urls for that, all count for both).  Equal scores at the cut are accepted.

Null urls and urls without `://` have an empty host and path; empty texts score 0.  Without rules of both kinds everything is accepted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import written

ORDER, SMOOTH = 2, 2.0
SYMBOLS = 64
#: Steps into which scores are counted to find the cut.
STEPS = 2000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of op10.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols 1 to 56; 0 begins a url, 57 and up are all other characters by their code.
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789/:.-_?=&#%+~@!,;*'()"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, at + 3)
    after = F.substring(url, rest, F.lit(2147483647))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _UPPER, _LOWER)
    left = F.substring(after, F.length(host) + 1, F.lit(2147483647))
    path = F.regexp_extract(left, r"^[^?#]*", 0)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fits(rule: Rule) -> Column:
    return ((F.col("host") == rule.host) | F.endswith("host", F.lit("." + rule.host))) & F.startswith("path", F.lit(rule.path))


_TABLE = [_ALPHABET.find(chr(i)) + 1 or 57 + i % (SYMBOLS - 57) for i in range(128)]


def symbols(url: Column) -> Column:
    """The folded characters of a url, as numbers."""
    known = F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER)
    table = F.array(*map(F.lit, _TABLE))
    one = lambda c: F.coalesce(F.get(table, F.ascii(c)), 57 + F.pmod(F.ascii(c), F.lit(SYMBOLS - 57)))
    return F.transform(F.filter(F.split(known, ""), lambda c: c != ""), one)


def cells(url: Column) -> Column:
    """For each character the number of its string: its context, then itself; the sequence shifted against itself."""
    seq = symbols(url)
    out = F.concat(F.array_repeat(F.lit(0), ORDER), seq)
    for k in range(ORDER - 1, -1, -1):
        out = F.zip_with(out, F.concat(F.array_repeat(F.lit(0), k), seq), lambda a, b: a * SYMBOLS + b)
    return F.slice(out, 1, F.size(seq))


def model(labelled: DataFrame) -> DataFrame:
    """One row: of each cell, millionths of log P(character | context) of accepted less that of rejected urls.

    labelled: accepted, codes.  Every table here has a row for each cell at most, whatever the input.
    """
    grams = labelled.select(F.explode("codes").alias("code"), F.col("accepted").cast("long").alias("a"))
    count = grams.groupBy("code").agg(F.sum("a").alias("x1"), F.sum(1 - F.col("a")).alias("x0"))
    cell = labelled.sparkSession.range(SYMBOLS ** (ORDER + 1)).select(F.col("id").cast("int").alias("code"))
    rows = cell.join(count, "code", "left").na.fill(0, ["x1", "x0"])
    weight = SMOOTH * SYMBOLS / 8
    logs = []
    for x in ("x1", "x0"):
        p: Column = F.lit(1 / SYMBOLS)
        for order in range(ORDER + 1):  # by the last `order` symbols of the context
            own = F.sum(x).over(W.partitionBy(F.col("code") % SYMBOLS ** (order + 1)))
            context = F.sum(x).over(W.partitionBy(F.floor(F.col("code") / SYMBOLS) % SYMBOLS**order))
            rows = rows.withColumn(f"{x}_{order}", (own + weight * p) / (context + weight))
            p = F.col(f"{x}_{order}")
        logs.append(F.log(p))
    ratio = F.round((logs[0] - logs[1]) * 1_000_000).cast("long")
    listed = rows.select("code", ratio.alias("v")).groupBy().agg(F.array_sort(F.collect_list(F.struct("code", "v"))).alias("cells"))
    return listed.select(F.col("cells.v").alias("ratios"))


def score(codes: Column, ratios: Column) -> Column:
    """Mean log ratio of the characters."""
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda t, c: t + F.get(ratios, c))
    return F.coalesce(total / 1e6 / F.nullif(F.size(codes), F.lit(0)), F.lit(0.0))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every url."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    best = sorted(rules, key=lambda r: (-len(r.name), r.name))
    rule, decided = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(best):
        rule, decided = F.when(fits(r), r.name).otherwise(rule), F.when(fits(r), r.verdict).otherwise(decided)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), decided.alias("decided"), cells(F.col("url")).alias("codes"))
    rows = rows.withColumn("tunes", F.pmod(F.coalesce(F.expr("try_cast(page_id as long)"), F.lit(0)), F.lit(5)) == 0)
    known = rows.where("decided is not null").select((F.col("decided") == "allow").alias("accepted"), "codes", "tunes")
    kinds = {(r["accepted"], r["tunes"]) for r in known.select("accepted", "tunes").distinct().collect()}
    tunes = F.col("tunes")
    if len({a for a, _ in kinds}) < 2:
        out = rows.withColumn("score", F.lit(0.0))
        cut = 0.0
    else:
        if len(kinds) < 4:  # too few urls to keep some of both kinds apart
            known, tunes = known.withColumn("tunes", F.lit(False)), F.lit(True)
        one = written(model(known.where("not tunes")), "urls")  # a single row of fixed size
        out = rows.withColumn("ratios", one.scalar()).withColumn("score", score(F.col("codes"), F.col("ratios")))
        step = F.floor(F.col("score") * STEPS / 10)
        found = out.where(F.col("decided").isNotNull() & tunes).groupBy(step.alias("s")).agg(F.sum((F.col("decided") == "allow").cast("long")).alias("a"), F.sum((F.col("decided") == "block").cast("long")).alias("b"))
        cut = best_cut([(r["s"], r["a"], r["b"]) for r in found.orderBy("s").collect()]) * 10 / STEPS  # scores lie within +-20: few rows
    verdict = F.coalesce("decided", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def best_cut(steps: list[tuple[int, int, int]]) -> int:
    """The step from which urls are accepted: shares of wrong accepted and wrong rejected urls add up to least."""
    accepted, rejected = sum(a for _, a, _ in steps), sum(b for _, _, b in steps)
    wrong_a, wrong_b, best = 0, rejected, (rejected / max(1, rejected), steps[0][0])
    for s, a, b in steps:
        wrong_a, wrong_b = wrong_a + a, wrong_b - b
        best = min(best, (wrong_a / max(1, accepted) + wrong_b / max(1, rejected), s + 1))
    return best[1]


def oracle_sql() -> str:
    """The same judgement in DuckDB's SQL, for op10's rules."""
    best = sorted(RULES, key=lambda r: (-len(r.name), r.name))
    fit = " ".join(f"WHEN (host='{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path,'{r.path}') THEN '{r.name}'" for r in best)
    decided = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in best)
    alphabet = _ALPHABET.replace("'", "''")
    weight, cells_, p = SMOOTH * SYMBOLS / 8, SYMBOLS ** (ORDER + 1), {}
    steps = ""
    for k in range(ORDER + 1):
        for x in ("x1", "x0"):
            low = f"p{k - 1}_{x}" if k else f"{1 / SYMBOLS}"
            p[x] = f"(sum({x}) OVER (PARTITION BY code % {SYMBOLS ** (k + 1)}) + {weight}::DOUBLE*{low})/(sum({x}) OVER (PARTITION BY (code // {SYMBOLS}) % {SYMBOLS**k}) + {weight}::DOUBLE) AS p{k}_{x}"
        steps += f", q{k} AS (SELECT *, {p['x1']}, {p['x0']} FROM {f'q{k - 1}' if k else 'cells'})"
    code = " + ".join([f"{SYMBOLS**k}*coalesce(lag(sym,{k}) OVER w,0)" for k in range(ORDER, 0, -1)] + ["sym"])
    return f"""WITH r AS (SELECT page_id, url, CASE WHEN instr(url,'://')>0 THEN substr(url, instr(url,'://')+3) END AS rest FROM pages),
 h AS (SELECT page_id, coalesce(url,'') AS url, coalesce(translate(regexp_extract(rest,'^[^/?#]*'),'{_UPPER}','{_LOWER}'),'') AS host, coalesce(regexp_extract(substr(rest, length(regexp_extract(rest,'^[^/?#]*'))+1),'^[^?#]*'),'') AS path FROM r),
 d0 AS (SELECT *, CASE {fit} END AS rule FROM h), d AS (SELECT *, CASE rule {decided} END AS decided FROM d0),
 c AS (SELECT page_id, decided, unnest(string_split(translate(url,'{_UPPER}','{_LOWER}'),'')) AS ch, unnest(range(length(url))) AS i FROM d WHERE url<>''),
 s AS (SELECT page_id, decided, i, CASE WHEN instr('{alphabet}', ch)>0 THEN instr('{alphabet}', ch) ELSE {57}+unicode(ch)%{SYMBOLS - 57} END AS sym FROM c),
 g AS (SELECT page_id, decided, {code} AS code FROM s WINDOW w AS (PARTITION BY page_id ORDER BY i)),
 n AS (SELECT code, count(*) FILTER (decided='allow') AS x1, count(*) FILTER (decided='block') AS x0 FROM g WHERE decided IS NOT NULL AND page_id%5<>0 GROUP BY 1),
 cells AS (SELECT a.code, coalesce(x1,0) AS x1, coalesce(x0,0) AS x0 FROM (SELECT unnest(range({cells_})) AS code) a LEFT JOIN n ON n.code=a.code){steps},
 v AS (SELECT code, round((ln(p{ORDER}_x1)-ln(p{ORDER}_x0))*1000000)::BIGINT AS v FROM q{ORDER}),
 t AS (SELECT page_id, sum(v)::DOUBLE/1e6::DOUBLE/count(*) AS score FROM g JOIN v USING(code) GROUP BY 1),
 o AS (SELECT d.*, coalesce(t.score,0::DOUBLE) AS score FROM d LEFT JOIN t USING(page_id)),
 b AS (SELECT floor(score*{STEPS}/10)::BIGINT AS s, count(*) FILTER (decided='allow') AS a, count(*) FILTER (decided='block') AS b FROM o WHERE decided IS NOT NULL AND page_id%5=0 GROUP BY 1),
 k AS (SELECT s+1 AS s, sum(a) OVER w/(SELECT sum(a) FROM b)::DOUBLE + ((SELECT sum(b) FROM b)-sum(b) OVER w)/(SELECT sum(b) FROM b)::DOUBLE AS e FROM b WINDOW w AS (ORDER BY s) UNION ALL SELECT min(s), 1::DOUBLE FROM b),
 m AS (SELECT s*10/{STEPS}::DOUBLE AS cut FROM k ORDER BY e, s LIMIT 1)
 SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN score>=(SELECT cut FROM m) THEN 'allow' ELSE 'block' END) AS verdict, score FROM o"""
