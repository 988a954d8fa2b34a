"""What the jobs' command lines share: settings from a file and from the line, a session for one run."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))  # the package, when the job is started by its path


def start(run: Callable[..., dict], words: dict[str, str], argv: list[str] | None = None) -> dict:
    """Run a job: settings come from --config (JSON), and paths of the line replace the file's.  The session is created
    here, unless one is there, and stopped at the end."""
    from pyspark.sql import SparkSession

    from attestra.session import ship

    parser = argparse.ArgumentParser(description=run.__doc__)
    parser.add_argument("--config", required=True, help="JSON file of settings")
    for name, meaning in words.items():
        parser.add_argument(f"--{name.replace('_', '-')}", help=meaning)
    given = parser.parse_args(argv)
    settings = json.loads(Path(given.config).read_text())
    settings |= {k: v for k, v in vars(given).items() if k in words and v is not None}
    if missing := [k for k in words if k not in settings]:
        parser.error(f"neither the line nor the file has {', '.join(missing)}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    session = SparkSession.builder.appName(run.__module__).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        ship(session)
        done = run(session, **settings)
        print(json.dumps(done))
        return done
    finally:
        session.stop()
