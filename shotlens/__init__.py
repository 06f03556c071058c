"""shotlens: a PySpark-native engine for shot, dialogue and gaze annotation tables."""
