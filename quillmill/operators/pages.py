"""Phrases of the texts that the engine writes."""

#: The opening of a reply by intent.
OPENINGS = {
    "RECHNUNG_INVOICE": "vielen Dank für Ihre Rechnung. Wir haben sie erhalten und prüfen sie.",
    "PREIS_ERHOEHUNG": "Ihre Mitteilung zu den neuen Preisen haben wir erhalten. Bitte senden Sie uns eine Begründung und ein Gegenangebot.",
    "LIEFERSCHEIN_DISCREPANCY": "wir gleichen die Lieferung mit unserer Bestellung ab und melden uns zum Ergebnis.",
    "MAHNUNG_ZAHLUNGSERINNERUNG": "wir prüfen den Zahlungsstand und melden uns umgehend.",
    "ALLGEMEINE_ANFRAGE": "vielen Dank für Ihre Nachricht. Wir melden uns in Kürze.",
}
