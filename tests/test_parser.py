"""What the query language reads and refuses."""

import pytest

from weftgraph.plans.parser import QueryError, lex, parse

GOOD = [
    "MATCH (n) RETURN n",
    "MATCH (a:P)-[r:K]->(b:P) WHERE a.x = 1 RETURN a, r, b",
    "MATCH (a)<-[:K|L]-(b)--(c)-->(d)<--(e) RETURN *",
    "MATCH (a)-[:K*]->(b), (c)-[:K*2]->(d), (e)-[:K*..3]-(f), (g)<-[:K*1..]-(h) RETURN count(*)",
    "OPTIONAL MATCH (a:P {x: 1, y: 'z'}) RETURN a.x AS x ORDER BY x DESC, a.y SKIP 1 LIMIT 2",
    "MATCH (a:P) WITH DISTINCT a.x AS x WHERE x > 1 UNWIND [1, 2] AS y RETURN x + y",
    "CREATE (a:P {x: 1})", "MATCH (a:P), (b:P) CREATE (a)-[:K {w: 1.5}]->(b)",
    "MERGE (a:P {x: 1}) ON CREATE SET a.y = 1 ON MATCH SET a.y = a.y + 1",
    "MATCH (a:P) SET a.x = 1, a.y = 'b'", "MATCH (a:P) DETACH DELETE a",
    "RETURN 1 AS x UNION ALL RETURN 2 AS x", "RETURN -1 + 2 * 3 ^ 4 % 5 // comment\n", "RETURN /* a /* b */ c */ 1",
    "RETURN 'it''s', \"a\\nb\", `a b`.c, $p, [1, [2]], {k: {l: 1}}, 1.5e-3",
    "RETURN CASE WHEN true THEN 1 ELSE 2 END, CASE 1 WHEN 1 THEN 'a' END",
    "RETURN [x IN [1, 2] WHERE x > 1 | x * 2], all(x IN [1] WHERE x > 0), l[1..2], m['k']",
    "RETURN NOT 1 IN [1] AND 'a' STARTS WITH 'b' OR x IS NOT NULL XOR y IS NULL", "RETURN 1 < 2 <= 3 <> 4, a =~ 'b.*'",
    "CREATE NODE TABLE T (a INT64, b STRING[] DEFAULT 'x', c DECIMAL(10, 2), PRIMARY KEY (a))", "CREATE REL TABLE IF NOT EXISTS R (FROM A TO B, w DOUBLE)",
    "DROP TABLE IF EXISTS T", "ALTER TABLE T ADD COLUMN x INT64", "ALTER TABLE T RENAME TO U", "COPY T FROM 'a.csv' (header = true)", "LOAD FROM 'x.ttl'",
    "CALL algo.pageRank(0.85, 20, 0.000001)", "CHECKPOINT", "BEGIN TRANSACTION", "COMMIT", "EXPLAIN MATCH (a) RETURN a",
]
BAD = ["", "MATCH", "MATCH (a RETURN a", "RETURN", "RETURN 1 +", "MATCH (a)-[:K->(b) RETURN a", "CREATE NODE TABLE T (a INT64)", "RETURN 'open", "FOO 1", "RETURN 1 2", "RETURN /* open"]


@pytest.mark.parametrize("text", GOOD)
def test_reads(text):
    assert parse(text)


@pytest.mark.parametrize("text", BAD)
def test_refuses(text):
    with pytest.raises(QueryError):
        parse(text)


def test_letters_beyond_ascii_stay():
    assert lex("'é'")[0].value == "é"


def test_precedence():
    e = parse("RETURN 1 + 2 * 3")[1][0][1][0][1].items[0][0]
    assert e == ("bin", "+", ("lit", 1), ("bin", "*", ("lit", 2), ("lit", 3)))
