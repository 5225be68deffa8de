"""Time registered queries (noop write) at a scale factor:
    python tools/time_query.py /root/testdata/sf0.1 key [key ...]"""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tagweave.plans.registry import load_all  # noqa: E402
from tagweave.session import build_session  # noqa: E402

sf, keys = sys.argv[1], sys.argv[2:]
spark = build_session(extra={"spark.driver.memory": "24g"})
Q = load_all()
for k in keys:
    t0 = time.time()
    Q[k].build(spark, sf).write.format("noop").mode("overwrite").save()
    print(f"{k}: {time.time() - t0:.1f}s", flush=True)
