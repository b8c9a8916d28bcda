"""Mine organisation contact data (website, e-mail, phone) from page tables with Spark."""
