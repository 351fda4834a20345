"""Column expressions. All run inside the JVM except masking, shortening and regexes of `arguments`."""
