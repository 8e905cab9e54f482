"""millrace: an analytics engine on Spark for asking questions of relational and text data safely."""
