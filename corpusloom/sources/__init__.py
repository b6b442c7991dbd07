"""Readers and writers: folders of text files, logs, read signals, evaluation cases, folder indexes."""
