"""Readers and writers of structures, archives, label files and token corpora."""
