"""Explicit schemas: nothing is inferred from data."""

from __future__ import annotations

import re


def columns(schema: str) -> list[tuple[str, str]]:
    """(name, type) of a schema text."""
    return [tuple(part.strip().split(" ", 1)) for part in re.split(r",(?![^<]*>)", schema)]


REACTIONS = "array<struct<name:string,count:int,users:array<string>>>"
RAW_MESSAGE = (f"type string, subtype string, user string, bot_id string, username string, text string, ts string, thread_ts string, reactions {REACTIONS}, "
    "reply_count int, latest_reply string, bot_profile struct<name:string>, _corrupt_record string")
USERS = ("id string, name string, profile struct<display_name:string,real_name:string>")
CHANNELS = ("id string, name string, is_member boolean, is_archived boolean, is_private boolean")
MESSAGES = ("channel_id string, channel_name string, channel_tier int, user_id string, user_name string, text string, ts_us long, thread_us long, reactions array<string>")
DOCUMENTS = ("doc_id string, thread_id string, channel_id string, channel_name string, channel_tier int, permalink string, ts_start long, ts_end long, "
    "participants array<string>, message_count long, summary string, raw_text string, pr_refs array<int>, commit_shas array<string>, ticket_refs array<string>, "
    "file_paths array<string>, file_basenames array<string>, symbols array<string>, reactions array<string>, is_bookmarked boolean, content_hash string")
PRS = ("number int, title string, author string, merged_at string, files array<string>, commit_shas array<string>, merge_commit_sha string")
TICKETS = ("key string, title string, status string, assignee string, pr_number int")
INCIDENTS = ("id string, title string, first_seen string, status string, pr_number int, url string")
CHECKPOINT = ("channel_name string, last_us long")
BLAME_LINES = ("selection_id long, line_no long, line string")
