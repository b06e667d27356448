"""Command line: scripts of a folder, or one script, to SQL, violations and verdicts.

    python -m tributary.cli INPUT OUTPUT [--profile strict] [--dry-run] [--baseline DIR]
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import time
from dataclasses import replace

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tributary.operators import parity
from tributary.operators import statements as S
from tributary.plans.pipeline import Config, run
from tributary.plans.profiles import PROFILES
from tributary.session import local_session
from tributary.sources import files


def report(event: str, **fields: object) -> None:
    """One JSON object a line to the log."""
    logging.getLogger("tributary").info(json.dumps({"event": event, **fields}))


def main(argv: list[str] | None = None) -> int:
    """0 if every file is valid, 2 if not, 3 if there are too many; settings come from TRIBUTARY_* variables, the profile from either."""
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("input")
    args.add_argument("output")
    args.add_argument("--profile", choices=PROFILES)
    args.add_argument("--baseline")
    args.add_argument("--dry-run", action="store_true")
    args.add_argument("--max-files", type=int, default=0, help="refuse more files than this; 0 takes all")
    got = args.parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    config, began = Config.of_environment(os.environ), time.time()
    if got.profile:
        config = replace(config, profile=got.profile)
    spark = local_session()
    scripts, large = files.read_scripts(spark, got.input, max_bytes=config.max_bytes)
    if got.max_files and scripts.count() > got.max_files:  # names and lengths only
        report("refused", reason=f"more than {got.max_files} files")
        return 3
    result = run(scripts, config)
    seen = Observation("verdicts")
    verdicts = result.verdicts.observe(seen, F.count_if(~F.col("ok")).alias("invalid"), F.count(F.lit(1)).alias("files"))
    files.write_scripts(S.scripts_of(result.statements), f"{got.output}/sql", got.dry_run)
    if got.dry_run:
        verdicts.write.format("noop").mode("overwrite").save()
    else:
        files.write_reports(verdicts, f"{got.output}/reports")
        files.write_reports(result.violations, f"{got.output}/violations")
        files.write_reports(result.rejects.unionByName(large), f"{got.output}/rejects")
        if got.baseline:
            baseline = S.statements_of(files.read_baselines(spark, got.baseline))
            files.write_reports(parity.compare(baseline, result.statements), f"{got.output}/parity")
    failed = seen.get["invalid"]  # counted while the reports were written
    report("done", files=seen.get["files"], invalid=failed, seconds=round(time.time() - began, 1))
    return 2 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
