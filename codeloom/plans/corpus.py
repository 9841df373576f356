"""A code corpus derived from the ``orders`` table, one function per order.

The text is plain SQL that Spark and DuckDB both run, so query and oracle read one corpus.
``@`` stands for the variable sigil and ``~`` for the declaration word of the language.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LAID_OUT = '''CASE
  WHEN lang = 'python' THEN concat(
    'def f', CAST(k % 50 AS STRING), ' ( n ) :  # note ', status, chr(10),
    CASE WHEN k % 3 = 0 THEN concat('    """adds n"""', chr(10)) ELSE '' END,
    CASE WHEN k % 4 = 2 THEN concat('    total = ', CAST(cust AS STRING), chr(10))
         ELSE concat('    s = "a b"', chr(10), '    total = 0', chr(10)) END,
    CASE WHEN k % 3 = 0 THEN concat('    if n < ', CAST(k % 97 AS STRING), ' :', chr(10),
           '        total = total + n', chr(10), '    else :', chr(10), '        total = total - 1', chr(10))
         WHEN k % 3 = 1 THEN concat('    if n > 1 :', chr(10), '        if n != 4 :', chr(10),
           '            total = total * 2', chr(10)) ELSE '' END,
    CASE WHEN k % 13 = 4 THEN concat('    for i in range ( n ) :', chr(10), '        if i > 2 :', chr(10),
           '            while n > 9 :', chr(10), '                n -= 1', chr(10), '                if n == 12 :', chr(10),
           '                    break', chr(10), '            continue', chr(10), '        else :', chr(10),
           '            if total != 3 :', chr(10), '                total += i', chr(10), '            else :', chr(10),
           '                return n', chr(10))
         WHEN k % 5 < 2 THEN concat('    for i in range ( ',
           CASE WHEN k % 5 = 0 THEN 'n' WHEN k % 7 < 3 THEN '1, n' ELSE '0, n, 2' END, ' ) :', chr(10),
           '        total += i', chr(10), CASE WHEN k % 7 = 1 THEN concat('        continue', chr(10)) ELSE '' END)
         ELSE concat('    while n > 3 :', chr(10), '        n -= 1', chr(10)) END,
    chr(10), '    return total', chr(10))
  WHEN lang = 'ruby' THEN concat(
    'def f', CAST(k % 50 AS STRING), ' ( n ) # note ', status, chr(10),
    CASE WHEN k % 16 = 7 THEN concat('  total = ', CAST(cust AS STRING), ' ;', chr(10))
         ELSE concat('  s = "a b" ;', chr(10)) END,
    CASE WHEN k % 3 = 0 THEN concat('  if n < ', CAST(k % 97 AS STRING),
           ' then total = total + n ; else total = total - 1 ; end', chr(10))
         WHEN k % 13 = 4 THEN concat('  if n < 7 then', chr(10), '    if n == 2 then total = 5 ; else total = 6 ; end', chr(10),
           '    while total > 9 do total -= 1 ; end', chr(10), '  else', chr(10), '    total = 8 ;', chr(10), '  end', chr(10))
         WHEN k % 13 = 5 THEN concat('  n . each do |x|', chr(10), '    if x == n . end', chr(10), '      total = x', chr(10), '    else', chr(10),
           '      begin', chr(10), '        total = 2 if x > 3', chr(10), '      end', chr(10), '    end', chr(10), '  end', chr(10))
         WHEN k % 3 = 1 THEN concat('  unless n == 2 then total = 3 ; else total = 4 ; end', chr(10))
         ELSE '' END,
    '  while n > 3 do n -= 1 ; end', chr(10), '  return total ; end', chr(10))
  ELSE replace(replace(concat(
    CASE WHEN lang = 'java' AND k % 3 = 0 THEN concat('import a.b ;', chr(10)) ELSE '' END,
    CASE WHEN lang IN ('javascript', 'php') THEN concat('function f', CAST(k % 50 AS STRING), ' ( @n ) {')
         WHEN lang = 'go' THEN concat('func f', CAST(k % 50 AS STRING), ' ( n int ) int {')
         ELSE concat('int f', CAST(k % 50 AS STRING), ' ( int n ) {') END, ' // note ', status, chr(10),
    CASE WHEN k % 3 < 2 THEN concat('~@total = ', CAST(cust AS STRING), ' ;', chr(10))
         ELSE concat('~@s = "a { b" ; /* text', chr(10), 'more */', chr(10)) END,
    CASE WHEN k % 3 = 0 THEN concat('if (@n<', CAST(k % 97 AS STRING),
           ') { @total = @total + @n; } else { @total = @total - 1; }', chr(10))
         WHEN k % 6 = 1 THEN concat('if (@n > 1 && @n < 5) { @total = 1; } else { @total = 2; }', chr(10))
         WHEN k % 6 = 4 THEN concat('if (@n == 1) { @total = 1; } else if (@n >= 9) { @total = 2; } else { @total = 3; }', chr(10))
         ELSE '' END,
    CASE WHEN lang = 'go' AND k % 13 = 4 THEN concat('for i = 0; i < n; i++ { if i > 2 { total += i; } else { if i != 1 { total -= 1; } else { n -= 1; } } }', chr(10))
         WHEN lang <> 'go' AND k % 13 = 4 THEN concat('for (@i = 0; @i < @n; @i++) { if (@i > 2) { while (@n > 9) { @n -= 1; if (@n == 12) { break; } } continue; } ',
           'else { if (@total != 3) { @total += @i; } else { return @n; } } }', chr(10))
         WHEN lang <> 'go' AND k % 13 = 5 THEN concat('while (@n > 3) { if (@n < 9) { for (@j = 0; @j < 2; @j++) { @n -= @j; } } else { do { @n--; } while (@n > 6); } }', chr(10))
         WHEN lang <> 'go' AND k % 13 = 6 THEN concat('for (@i = 0; @i < 9; @i++) { switch (@i) { case 1: break; default: if (@n > 1) { continue; } } }', chr(10))
         WHEN lang = 'go' AND k % 5 < 2 THEN concat('for i = 0; i < n; i++ { total += i; }', chr(10))
         WHEN lang = 'go' THEN concat('for n > 3 { n -= 1; }', chr(10))
         WHEN k % 5 = 0 THEN concat('for (@i = 0; @i < @n; @i++) { @total += @i; if (@total > 9) break; }', chr(10))
         WHEN k % 5 = 1 THEN concat('for (; @n != 7; ) { @n -= 1; }', chr(10))
         WHEN k % 5 = 2 THEN concat('while (@n > 3) { @n -= 1; }', chr(10))
         ELSE concat('while (@go ( @n )) { @obj . run ( @n , "x" ) ; }', chr(10)) END,
    CASE WHEN lang = 'go' THEN ''
         WHEN k % 7 = 0 THEN concat('@y = @x++; @w = @y--;', chr(10))
         WHEN k % 7 = 1 THEN concat('@y = ++@x;', chr(10)) ELSE '' END,
    CASE WHEN lang = 'go' THEN ''
         WHEN k % 9 = 0 THEN concat('@y = @n > 2 ? @total : @x;', chr(10))
         WHEN k % 9 = 1 THEN concat('~@z = (@n != 1) ? 1 : 2;', chr(10)) ELSE '' END,
    CASE WHEN lang <> 'go' AND k % 10 = 1 THEN 'return @n > 0 ? @total : @y; }' ELSE 'return @total; }' END),
    '@', CASE WHEN lang = 'php' THEN '$' ELSE '' END),
    '~', CASE lang WHEN 'javascript' THEN 'let ' WHEN 'php' THEN '' WHEN 'go' THEN 'var ' ELSE 'int ' END)
  END'''

# Some rows of the languages in which a line break may end a statement have no other end of it.
_OPEN = "k % 11 < 3 AND lang"
_PLAIN = f"replace(replace({_LAID_OUT}, concat(' ;', chr(10)), chr(10)), concat(';', chr(10)), chr(10))"
CODE_EXPR = f'''CASE WHEN {_OPEN} IN ('go', 'javascript') THEN {_PLAIN}
  WHEN {_OPEN} = 'ruby' THEN replace(replace(replace({_PLAIN}, ' then ', chr(10)), ' ; else ', concat(chr(10), 'else', chr(10))), ' ; end', concat(chr(10), 'end'))
  ELSE {_LAID_OUT} END'''

SEED_EXPRS = (
    "o_orderkey AS id",
    "o_orderkey AS k",
    "o_custkey AS cust",
    "o_orderstatus AS status",
    '''CASE o_orderkey % 8 WHEN 0 THEN 'c' WHEN 1 THEN 'c_sharp' WHEN 2 THEN 'go' WHEN 3 THEN 'java'
       WHEN 4 THEN 'javascript' WHEN 5 THEN 'php' WHEN 6 THEN 'python' ELSE 'ruby' END AS lang''',
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key to as many tasks as the session shuffles to: for work per row far above the cost of the move,
    and for what is grouped by the key afterwards."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def ordered(df: DataFrame, key: str) -> DataFrame:
    """Rows in order of key over as many tasks as the session shuffles to. What is computed from them row by row keeps the
    order, so costly rows need no sort and are not computed for its sample of keys."""
    return df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key)


def code_corpus(spark: SparkSession, sf_dir: str, deal: Callable[[DataFrame, str], DataFrame] = placed) -> DataFrame:
    """(id, lang, code) over all orders, dealt by id while a row is four short columns."""
    seeds = table(spark, sf_dir, "orders").selectExpr(*SEED_EXPRS)
    return deal(seeds, "id").selectExpr("id", "lang", f"{CODE_EXPR} AS code")


def corpus_oracle() -> str:
    return f"SELECT id, lang, {CODE_EXPR} AS code FROM (SELECT {', '.join(SEED_EXPRS)} FROM orders) AS seed"
