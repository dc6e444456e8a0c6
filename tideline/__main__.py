"""python -m tideline CONFIG: runs the flows of a configuration until a signal to end."""

from __future__ import annotations

import logging
import signal
import sys
import threading

from pyspark.sql import SparkSession

from tideline.streaming import config
from tideline.streaming.manager import Manager
from tideline.streaming.metrics import Metrics


def main(path: str) -> int:
    logging.basicConfig(level=logging.INFO)
    settings = config.load(path)
    spark = SparkSession.builder.appName("tideline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        print("spark.checkpoint.dir is not set: it must name a folder that all executors share", file=sys.stderr)
        return 2
    manager, metrics = Manager(), Metrics()
    build = lambda d: config.build(spark, d, f"{root}/flows")
    for definition in settings["flows"]:
        flow = build(definition)
        manager.register(flow)
        if config.auto_start(definition):
            manager.start(flow.id)
    end = manager.poll_metrics(metrics)
    server = manager.server(settings["listen"], build, metrics)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    done = threading.Event()
    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, lambda *_: done.set())
    done.wait()
    server.shutdown()
    end()
    manager.stop_all(60)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1]))
