import json
import time

from docquery.streaming import debounce


def test_debounced_stream(spark, tmp_path):
    source, out, state = (tmp_path / x for x in ("in", "out", "state"))
    source.mkdir()
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass",)}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = spark.readStream.schema("key string, path string").json(str(source))
        query = debounce.debounced(events, 0.5, 5.0).writeStream.format("json").option("path", str(out)).option("checkpointLocation", str(state)).trigger(processingTime="1 second").start()
        (source / "a.json").write_text("\n".join(json.dumps({"key": "r", "path": p}) for p in ("x.md", "y.md", "x.md")))
        rows = []
        for _ in range(40):
            time.sleep(1.5)
            rows = [json.loads(line) for f in out.glob("*.json") for line in f.read_text().splitlines()]
            if rows or query.exception():
                break
        query.stop()
        assert query.exception() is None
        assert rows == [{"key": "r", "events": 3, "paths": ["x.md", "y.md"]}]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
