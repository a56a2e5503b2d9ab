"""Column builders: text, hashing, identifiers, intent, privacy. No UDFs; all stay in the JVM."""
