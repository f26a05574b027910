"""Corpus preparation over job logs: the texts that conversion jobs leave behind, cleaned and packed for training."""
