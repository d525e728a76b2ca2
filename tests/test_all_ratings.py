"""Session reports rate every conversation that has an answer."""

from conftest import data_folder
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.plans.registry import Tables


def test_every_answered_session_is_rated(spark):
    folder = data_folder("sf0.001")
    answered = {r[0] for r in Tables(spark, folder).messages.filter("role = 'assistant'").select("session_id").collect()}
    report = entry.queries()["o6_session_report_all"](spark, folder).collect()
    assert {r["session_id"] for r in report if r["rating"] != "—"} == answered & {r["session_id"] for r in report}
    sheets = entry.queries()["a8_export_panel_sheets"](spark, folder)
    assert {r["name"] for r in sheets.filter("sheet = 'indicators' AND value > 0").collect()} == {"conversations", "messages"}
    assert {(r["name"], r["rating"]) for r in sheets.filter("sheet = 'sessions'").collect()} == {(str(r["number"]), r["rating"]) for r in report}


def test_the_export_holds_ratings_of_all_conversations(spark, monkeypatch):
    from lectern.sources import sinks

    written = []
    monkeypatch.setattr(sinks, "export_panel_tables", lambda indicators, sessions, path, f=sinks.export_panel_tables: (
        written.append(sessions.filter(F.col("rating") != "—").count()), f(indicators, sessions, path)))
    entry.queries()["a8_export_panel_tables"](spark, data_folder("sf0.001")).count()
    report = entry.queries()["o6_session_report_all"](spark, data_folder("sf0.001"))
    assert written == [report.filter(F.col("rating") != "—").count()]
