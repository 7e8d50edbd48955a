"""Sessions of more tickers than a locate has numbers, against the SQL."""

import pytest
from compare import assert_same

from newsloom.plans import catalog, files_catalog

EXCHANGE = ["q130_recovered_packets", "q86_session_prints", "q90_directory_symbols", "q87_session_counters", "q88_depth_after", "q89_tops_of_book"]


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """Folder of a tape of 66,000 tickers, two prints of each ticker of Z."""
    import duckdb

    d = tmp_path_factory.mktemp("many")
    con = duckdb.connect()
    con.execute(f"""copy (select row_number() over (order by i, c) as print_id, chr(65 + (i % 26)::int) || i as ticker, 1772438701752957932 + i * 1000003 + c as ts_ns, (20000 + i)::int as px_e4, (100 + i % 7)::int as shares, true as printable
      from range(66000) x(i), range(2) y(c) where c = 0 or i % 26 = 25) to '{d}/tape.parquet' (format parquet)""")
    con.execute(f"copy (select 'A' || i * 26 as ticker from range(1000) x(i)) to '{d}/symbol_info.parquet' (format parquet)")
    return str(d)


@pytest.mark.parametrize("name", EXCHANGE)
def test_more_tickers_than_locates(spark, many, name):
    assert assert_same(catalog.queries()[name](spark, many), catalog.oracle_sql()[name], many) > 0


def test_an_initial_of_more_sessions(spark, many, monkeypatch):
    """With few locates to a session, an initial has sessions enough for all its tickers, each locate once."""
    monkeypatch.setattr(files_catalog, "LOCATES", 1000)
    r = files_catalog._messages(spark, many).where("type = 'R'")
    got = [(x.session, x.locate, x.stock) for x in r.select("session", "locate", "stock").collect()]
    assert len(got) == len({x[:2] for x in got}) == 66000 and max(x[1] for x in got) == 1000
    assert {x[0] for x in got if x[2][0] == "Q"} == {"Q", "Q_1", "Q_2"}


@pytest.mark.parametrize("name", ["q87_session_counters", "q90_directory_symbols"])
def test_a_session_read_once_is_not_stored(spark, many, name):
    assert "exchange_session" in catalog.queries()[name](spark, many)._jdf.queryExecution().executedPlan().toString()
