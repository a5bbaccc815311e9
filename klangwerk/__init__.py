"""klangwerk: a PySpark-native engine for phonetic retrieval and lexical analytics."""
