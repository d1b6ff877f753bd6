"""Column expressions. Everything here stays inside Catalyst except the CRC-24 Arrow UDF."""
