"""Timed-text analytics on Spark: subtitles, transcripts and other intervals with text.

Every operator takes DataFrames and gives a DataFrame. Rows belong to a *track* (one
subtitle file, one speaker, one stream of frames), named by the column ``track``.
"""
