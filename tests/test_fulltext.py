import random
import re

import duckdb
import pytest

from docloom.functions.stems import STOP_WORDS, stem
from docloom.operators import fulltext

# Words and stems of the method's published sample vocabulary.
PUBLISHED = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol
consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort
consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel
kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit
knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock
knopp knopp knot knot knots knot generate generat general general generic generic generous generous generously generous communal communal community communiti arsenal arsenal
skies sky dying die news news only onli inning inning proceed proceed exceeding exceed happy happi cry cri by by say say hopping hop hoping hope ties tie cries cri
gas gas this this kiwis kiwi luxuriated luxuri relational relat conditional condit rational ration valency valenc hesitancy hesit digitizer digit
operator oper feudalism feudal decisiveness decis hopefulness hope formality formal sensitivity sensit triplicate triplic formative format formalize formal electrical electr
revival reviv adoption adopt rate rate controlling control rolling roll""".split()


@pytest.mark.parametrize("word, want", list(zip(PUBLISHED[::2], PUBLISHED[1::2], strict=True)))
def test_stems(word, want):
    assert stem(word) == want


def plain(rows, query):
    asked = fulltext.terms(query)
    out = {}
    for key, text in rows:
        spots = [(i, stem(w)) for i, w in enumerate(re.findall(r"\w+", (text or "").lower())) if w not in STOP_WORDS and stem(w) in asked]
        if not asked or {s for _, s in spots} != set(asked):
            continue
        covers = [(spots[i][0], spots[j][0]) for i in range(len(spots)) for j in range(i, len(spots)) if {s for _, s in spots[i : j + 1]} == set(asked)]
        best = [c for c in covers if not any(d != c and c[0] <= d[0] and d[1] <= c[1] for d in covers)]
        out[key] = round(sum(1 / (1 + r - lo + 1 - len(asked)) for lo, r in best), 6)
    return out


ROWS = [(1, "Licensed works are licenses to work."), (2, "the works"), (3, None), (4, ""), (5, "A license, of the work; working and licensing, licensed"), (6, "of the and"), (7, "Work"), (8, "works " * 20 + "license")]


@pytest.mark.parametrize("query", ["licensed works", "the license", "work work working", "of the", "", "absent license", "license work to"])
def test_search_is_brute_force(spark, query):
    r = random.Random(1)
    bits = ["license", "licensed", "working", "works", "the", "a", "to", "other", "Absent", "é"]
    rows = ROWS + [(100 + i, " ".join(r.choice(bits) for _ in range(r.randint(0, 30)))) for i in range(150)]
    index = fulltext.postings(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    assert {x.id: x["rank"] for x in fulltext.search(index, query, "id").collect()} == pytest.approx(plain(rows, query), abs=2e-6)


def test_postings_by_sql(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id long, text string")
    index = fulltext.stored(df, "id", "text", f"file://{tmp_path}/postings")
    index.count()
    found = fulltext.search(index, "licensing works", "id", k=2).collect()
    con = duckdb.connect()
    files = f"read_parquet('{tmp_path}/postings/*.parquet')"
    both = con.execute(f"SELECT id FROM {files} WHERE stem IN ('licens', 'work') GROUP BY id HAVING count(DISTINCT stem) = 2 ORDER BY id").fetchall()
    assert [x[0] for x in both] == [1, 5, 8] and {x.id for x in found} <= {1, 5, 8} and len(found) == 2
    assert con.execute(f"SELECT positions FROM {files} WHERE id = 5 AND stem = 'licens'").fetchall() == [([1, 7, 8],)]
    assert {x.id: x["rank"] for x in fulltext.search(index, "absent works", "id", match="any").collect()} == {1: 2.0, 2: 1.0, 5: 2.0, 7: 1.0, 8: 20.0}


def test_postings_are_dealt_once(spark, tmp_path, monkeypatch):
    """The words of a text meet where it is read: on the way to the table there is one exchange."""
    from pyspark.sql.readwriter import DataFrameWriter

    plans = []
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, **k: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), write(self, path, **k))[1])
    rows = [(1, "Licences of one version, and licences"), (1, "versions"), (2, None), (3, "the of"), (4, "licence")]
    index = fulltext.stored(spark.createDataFrame(rows, "id long, text string"), "id", "text", f"file://{tmp_path}/once")
    assert {(r.id, r.stem): r.positions for r in index.collect()} == {(1, "licenc"): [0, 5], (1, "one"): [2], (1, "version"): [0, 3], (4, "licenc"): [0]}
    assert [p.count("Exchange ") for p in plans] == [1]
