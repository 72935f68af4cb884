"""Streams of page features: one batch after another, with packets that may span batches.

``drop_folder`` reads new Parquet files as they arrive; ``segment_stream`` keeps each file's open packet as state and gives a packet
out once the next one begins or the file's last page has come. ``into_table`` writes each micro-batch once under its own number.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sheafwork.session import ship_package

FEATURES = "file_id string, page_idx int, is_header boolean, page_num int, page_total int, readable boolean, worksheet_type string, last_page boolean"
PACKETS = "file_id string, packet_index int, page_indices array<int>, header_page int, declared_total int, is_orphan boolean, worksheet_type string, issues array<string>"


def drop_folder(spark: SparkSession, folder: str, schema: str = FEATURES, files: int = 1) -> DataFrame:
    """New files of a folder as a stream, ``files`` of them a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


class PacketFold:
    """The rule of packets as state: ``feed`` takes pages in order and returns the packets that closed."""

    def __init__(self, state: dict | None = None):
        self.count = state["count"] if state else 0
        self.open = state["open"] if state else None

    def state(self) -> dict:
        return {"count": self.count, "open": self.open}

    def _close(self) -> list[dict]:
        done = self.open
        self.open = None
        if done is None:
            return []
        if done["total"] is not None and len(done["pages"]) != done["total"]:
            done["issues"].append("total_mismatch")
        return [done]

    def feed(self, idx: int, is_header: bool, num: int | None, total: int | None, kind: str | None, last: bool = False) -> list[dict]:
        readable = num is not None
        out = []
        if self.open is not None:
            n = len(self.open["pages"])
            full = self.open["total"] is not None and n + 1 > self.open["total"]
            if is_header or full or readable and num != n + 1:
                out += self._close()
        if self.open is None:
            self.count += 1
            issues = [] if readable else ["footer_unreadable"]
            if is_header:
                issues += ["header_not_first"] if readable and num != 1 else []
                issues += ["type_unreadable"] if kind is None else []
            else:
                issues.insert(0, "no_header")
            self.open = {"index": self.count, "pages": [idx], "header": idx if is_header else None, "total": total if readable else None, "orphan": not is_header, "kind": kind if is_header else None, "issues": issues}
        else:
            self.open["pages"].append(idx)
            if not readable:
                self.open["issues"].append("sequence_unreadable")
            elif self.open["total"] is not None and total != self.open["total"]:
                self.open["issues"].append("total_differs")
        return out + (self._close() if last else [])


def _int(x) -> int | None:
    return None if pd.isna(x) else int(x)


def _segment(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    fold = PacketFold(json.loads(state.get[0]) if state.exists else None)
    pages = pd.concat(list(batches)).sort_values("page_idx")
    done = []
    for p in pages.itertuples():
        num = _int(p.page_num) if p.readable else None
        done += fold.feed(int(p.page_idx), bool(p.is_header), num, _int(p.page_total), None if pd.isna(p.worksheet_type) else p.worksheet_type, bool(p.last_page))
    if bool(pages["last_page"].any()):
        state.remove()  # the file is complete, nothing of it is kept
    else:
        state.update((json.dumps(fold.state()),))
    rows = [(key[0], d["index"], d["pages"], d["header"], d["total"], d["orphan"], d["kind"], d["issues"]) for d in done]
    columns = [c.split()[0] for c in PACKETS.split(", ")]
    yield pd.DataFrame(rows, columns=columns).astype({"header_page": "Int32", "declared_total": "Int32"})


def segment_stream(features: DataFrame) -> DataFrame:
    """Packets of a stream of page features; pages of a file arrive in order, the last one marked."""
    ship_package(features.sparkSession)
    return features.groupBy("file_id").applyInPandasWithState(_segment, PACKETS, "fold string", "append", GroupStateTimeout.NoTimeout)


def into_table(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Runs over all that has arrived and stops. A batch writes its own folder anew, so that a repeated batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
