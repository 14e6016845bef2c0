"""Readers and sinks on small files of our own."""

import json

from spanloom.sources import readers, sinks


def _write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_coco(spark, tmp_path):
    path = _write(
        tmp_path / "c.json",
        {
            "images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 10}, {"id": 2, "file_name": "b.jpg", "width": 5, "height": 5}],
            "categories": [{"id": 3, "name": "cat", "supercategory": "animal"}],
            "annotations": [{"id": 9, "image_id": 1, "category_id": 3, "area": 20.0, "bbox": [0, 0, 4, 5], "iscrowd": 0}, {"id": 8, "image_id": 1, "category_id": 4, "area": 2.0, "bbox": [0, 0, 1, 2], "iscrowd": 0}, {"id": 7, "image_id": 2, "category_id": 3, "area": 9.0, "bbox": [0, 0, 3, 3], "iscrowd": 1}],
        },
    )
    rows = readers.coco(spark, path).collect()
    assert [(r.sample_id, [a.name for a in r.annotations]) for r in rows] == [("1", ["category_4", "cat"])]
    assert [len(r.annotations) for r in readers.coco(spark, path, min_area=5.0).collect()] == [1]


def test_mot(spark, tmp_path):
    path = _write(tmp_path / "gt.txt", "2,1,5,5,2,2,1,1,0.5\n1,1,4,4,2,2,1,,\n1,2,0,0,1,1,1,1,1\n")
    rows = {r.object_id: r for r in readers.mot(spark, path).collect()}
    assert [b.frame_id for b in rows[1].boxes] == [1, 2] and rows[1].boxes[0]["class"] == -1 and rows[1].boxes[0].visibility == 1.0
    assert (rows[2].detections, rows[2].first_frame, rows[2].last_frame) == (1, 1, 1)


def test_lines(spark, tmp_path):
    path = _write(tmp_path / "t.jsonl", '{"qid": 1, "q": "what", "a0": "x", "ts_start": 2.0}\nnot json\n')
    rows = readers.tvqa(spark, path).collect()
    assert [(r.sample_id, r.ts_end) for r in rows] == [("1", 7.0)]
    path = _write(tmp_path / "j.jsonl", '{"task_id": "a", "actions": [{"action": "THINK"}]}\n{"task_id": "b", "trajectory_type": "trap"}\n')
    assert sorted((r.task_id, r.trajectory_type) for r in readers.trajectories(spark, path).collect()) == [("a", "golden"), ("b", "trap")]


def test_activity_quarantine(spark, tmp_path):
    path = _write(tmp_path / "a.json", [{"video_id": "v", "duration": 9.0, "timestamps": [[0, 1]], "sentences": ["s"]}, {"video_id": "w", "timestamps": [[0, 1]], "sentences": []}, {"timestamps": [], "sentences": []}])
    good, bad = readers.activity(spark, path)
    assert [(r.sample_id, r.events[0].sentence) for r in good.collect()] == [("v", "s")]
    assert sorted(r.reason for r in bad.collect()) == ["length_mismatch", "missing_id"]


def test_hiertext_and_docvqa(spark, tmp_path):
    path = _write(tmp_path / "h.json", {"annotations": [{"image_id": "i", "paragraphs": [{"legible": False, "lines": [{"words": [{"text": "a"}, {"text": "b", "legible": True}]}]}]}]})
    assert [(r.text, r.legible) for r in readers.hiertext(spark, path).collect()] == [("a", False), ("b", False)]
    (tmp_path / "ocr").mkdir()
    _write(tmp_path / "ocr" / "p1.json", {"recognitionResults": [{"page": 1, "lines": [{"text": "x y", "words": [{"text": "x", "boundingBox": [1, 2, 5, 2, 5, 6, 1, 6]}]}]}]})
    qa = _write(tmp_path / "qa.json", {"data": [{"questionId": 4, "question": "q", "answers": ["x"], "image": "docs/p1.png"}, {"questionId": 5, "question": "r", "answers": [], "image": "p2.png"}]})
    rows = {r.sample_id: r.tokens for r in readers.docvqa(spark, qa, str(tmp_path / "ocr")).collect()}
    assert rows["4"][0].box == [1, 2, 5, 6] and rows["5"] == []


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, text string")
    assert sinks.store(df, str(tmp_path / "store"), "text") == 2
    assert sinks.store(df, str(tmp_path / "store"), "text") == 0
    for _ in range(11):
        last = sinks.snapshot(df, str(tmp_path / "snap"), keep=2)
    assert last == 11 and sinks.newest(spark, str(tmp_path / "snap")).count() == 3
    assert sorted(p.name for p in (tmp_path / "snap").iterdir()) == ["version=10", "version=11"]
