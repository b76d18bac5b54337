"""Schemas of the analysed corpus and the reader's state."""

from __future__ import annotations

CORPUS_SENTENCE = "sentence_id long, build string, origin string, text string, translation string, raw_text string, source_ids array<int>, video_id long, start_time double, end_time double, teachable boolean, language string, channel string"
CORPUS_UNIT = "sentence_id long, kind string, key string, surface string"
KNOWN = "kind string, key string"
GOALS = "kind string, key string, rank int"
RAW_LINE = "line_id int, video_id string, start_time double, duration double, content string"
CARDS = "kind string, key string, due_date timestamp, interval_days double, ease_factor double, repetitions int, last_review timestamp"
ROADMAP = "source string, position int, kind string, key string, sentence_id long, gain long, score double, now_readable long, readable long, occurrences long, beside string"
VIDEO_SCORE = "source string, video_id long, lines long, minutes double, comprehension double, teachable long, teaches long, watch double, next_words array<struct<kind:string,key:string,n:long>>"
COMPOUND_RULE = "rule_id int, whole_kind string, whole_key string"
COMPOUND_PART = "rule_id int, part_no int, kind string, key string"
