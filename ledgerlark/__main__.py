"""``python -m ledgerlark SOURCE --out FOLDER``: reconciles an inbox and writes the report."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .constants import CATEGORIES
from .plans import reconcile as P
from .sources import resolutions as S
from .sources.inbox import read_emails, read_report, read_resolutions
from .sources.shared import drop_written, written


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ledgerlark", description=__doc__)
    parser.add_argument("source", help="folder with inbox/ and attachments/")
    parser.add_argument("--out", required=True, help="folder of the outputs")
    parser.add_argument("--resolutions", help="JSON file with people's decisions and corrections")
    parser.add_argument("--saved", metavar="FOLDER", help="table of saved decisions, which count more than the file's")
    parser.add_argument("--resolve", nargs="*", metavar="ID=DECISION", default=[], help="save these decisions (OK or MISMATCH) in --saved first")
    parser.add_argument("--reviewer", default="human_reviewer", help="who resolves")
    parser.add_argument("--note", help="why")
    parser.add_argument("--retry", nargs="*", metavar="ID", help="run these messages again, and those that the report in --out doesn't have")
    parser.add_argument("--ask-send-as", default="GENERAL", choices=CATEGORIES, help="category of messages that only ask for a draft")
    a = parser.parse_args(arguments)
    told = [x.rpartition("=")[::2] for x in a.resolve]
    if told and (not a.saved or any(not i or d not in ("OK", "MISMATCH") for i, d in told)):
        parser.error("--resolve needs --saved, and an id and OK or MISMATCH each")
    spark = SparkSession.builder.appName("ledgerlark").getOrCreate()
    if told:
        S.save(spark.createDataFrame([(i, d, a.reviewer, a.note) for i, d in told], "email_id string, decision string, reviewer string, note string"), a.saved)
    decided = read_resolutions(spark, a.resolutions) if a.resolutions else None
    if a.saved:
        decided = S.merged(decided, S.read_saved(spark, a.saved)) if decided is not None else S.read_saved(spark, a.saved)
    prior = None if a.retry is None else read_report(spark, f"{a.out.rstrip('/')}/report.json", P.REPORT_SCHEMA)
    rows = P.reconcile_folder(spark, a.source, decided, a.ask_send_as, prior, a.retry)
    # Stored first: a retry reads what it replaces, and four outputs share it.
    P.write_outputs(written(rows), a.out, read_emails(spark, a.source), decided)
    drop_written(spark)


if __name__ == "__main__":
    main()
