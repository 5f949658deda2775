"""Rows for small fixtures."""

from colloquy.schema import CONVERSATION, LABEL_SET


def turn(turn_id, speaker="A", start=0.0, end=1.0, text="Hello there.", overlap=None):
    return dict(turn_id=turn_id, speaker=speaker, start=start, end=end, text=text, overlap=overlap)


def conversation(cid, turns, speakers=None, revision="1", **meta):
    return dict(conversation_id=cid, audio_path=None, speakers=speakers, meta={"revision": revision, **meta} if revision is not None else None, turns=turns)


def conversations(spark, rows):
    return spark.createDataFrame(rows, CONVERSATION)


def label(turn_id, addressees, confidence=0.9, labeler="x", rationale=None):
    return dict(turn_id=turn_id, addressees=addressees, confidence=confidence, rationale=rationale, labeler=labeler)


def label_sets(spark, rows):
    return spark.createDataFrame([dict(conversation_id=c, labels=items) for c, items in rows], LABEL_SET)


def tuples(frame):
    return sorted(map(tuple, frame.collect()), key=repr)
