"""Operators over long-form samples (log_id, series, seq, t, v): each takes and returns DataFrames."""
