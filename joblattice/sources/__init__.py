"""Readers: raw feeds, boards, directories, crawl logs, profiles and snapshots."""
