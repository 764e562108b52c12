"""Tramline: a Spark-native engine for timetable feeds and corpus preparation."""
