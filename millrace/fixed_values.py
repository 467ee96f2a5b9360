"""Names, word lists, patterns and texts that decide results.

Everything in this file is data that must be exactly as written for results to
be right. There is no logic here; callers may pass their own lists instead.
"""

# Fields of one record, in table order, with the names shown in the audit log.
FIELD_LABELS = {
    "move": "My Move",
    "stage": "Stage",
    "company": "Company",
    "title": "Job Title",
    "fit": "Fit",
    "category": "Category",
    "location": "Location",
    "exp": "Exp. Req.",
    "desc": "Job Description",
    "why": "Why I Fit",
    "source": "Source",
    "link": "Apply Link",
    "applied_date": "Applied On",
    "next_followup": "Next Follow-up",
    "contact": "Contact",
    "salary_range": "Salary Range",
    "hybrid": "Hybrid",
    "notes": "Notes",
    "process": "Hiring Process",
    "updated": "Updated",
    "priority": "Priority",
}

# Fields that no incoming item may write.
MANUAL_FIELDS = ["salary_range", "hybrid"]

# Allowed values of the two hand-kept fields.
MOVE_VALUES = ["⭐ To Apply", "📝 Tailor CV", "🙋 Reach Out", "✅ Applied", "❌ Not Relevant"]
STAGE_VALUES = ["📤 Applied", "📞 Screening", "🎤 Interview", "📝 Home Assignment",
                "🎯 Action Required", "🎉 Offer", "❌ Rejected", "🔇 No Response"]

# Substrings that the ordering and the display rules look for.
ACTIVE_STAGES = ["Screening", "Interview", "Home Assignment", "Action Required", "Offer"]
MARKED_MOVES = ["To Apply", "Tailor CV", "Reach Out"]
CLOSED_STAGES = ["Rejected", "No Response"]

# Words ignored when names are compared.
PLACE_WORDS = ["hybrid", "remote", "onsite", "office"]
FILLER_WORDS = ["the", "a", "an", "and", "of", "for"]

# Query parameters that identify a posting.
POSTING_PARAMETER = r"^jk$|job|jid|position|vacancy|req"

REVIEW_FLAG = "⚠️ For Review"

# Audit-log actions.
ACTION_ADDED = "job added"
ACTION_UPDATED = "status updated"
ACTION_FLAGGED = "⚠️ flagged for review"

# Six code points that mailing systems use as invisible padding.
INVISIBLE = ["\u200b", "\u200c", "\u200d", "\u034f", "\ufeff", "\u00ad"]

# Tags whose content is not text, and tags that break a line.
MUTED_TAGS = ["style", "script", "head", "title"]
BREAK_TAGS = ["p", "div", "tr", "br", "li", "table",
              "h1", "h2", "h3", "h4", "h5", "h6", "hr"]

# Link rules: source, pattern with one group, address template.
LINK_RULES = [
    ("indeed", r"jk(?:=|%3D)([0-9a-fA-F]{10,20})", "https://www.indeed.com/viewjob?jk={}"),
    ("linkedin", r"linkedin\.com/(?:comm/)?jobs/view/(\d{6,12})",
     "https://www.linkedin.com/jobs/view/{}"),
    ("greenhouse", r"gh_jid(?:=|%3D)(\d{4,12})",
     "https://boards.greenhouse.io/embed/job_app?token={}"),
    ("lever", r"jobs\.lever\.co/[^/\s\"']+/([0-9a-f-]{8,40})", "https://jobs.lever.co/-/{}"),
]
HREF_PATTERN = r"href=[\"']?(https?://[^\"'\s<>]+)"

# Source tags, tested in this order against the lower-cased sender.
SOURCE_TAGS = ["indeed", "linkedin", "glassdoor", "greenhouse", "lever"]

ALERT_SENDERS = ["jobalert.indeed.com", "jobalerts-noreply@linkedin.com",
                 "jobs-noreply@linkedin.com"]

MAIL_ADDRESS = "https://mail.google.com/mail/u/0/#all/"
KEEP_SNAPSHOT_DAYS = 30

# Rows of the activity report.
ACTIVITY_LABELS = {
    "cv": "CVs submitted",
    "nr": "Marked not relevant",
    "new": "New jobs added to pool",
    "adv": "Processes advanced (screening+)",
    "rej": "Rejections received",
    "mail": "New recruiter / ATS emails",
}

SUBJECT_PREFIX = "Job search digest"

# Texts of a rendered digest.
NO_LINKS_WARNING = ("⚠️ zero recognised links — the board may have changed its "
                    "template. Read the text below and raise a flag.")
PART_SEPARATOR = "\n\n─────\n\n"

# Lines of a rendered message digest.
DIGEST_SUBJECT = "Subject: "
DIGEST_FROM = "From:    "
DIGEST_DATE = "Date:    "
DIGEST_MAIL = "Gmail:   "
DIGEST_NO_SUBJECT = "(no subject)"
DIGEST_LINKS = "=== canonical job links ("
DIGEST_LINKS_END = ") ==="
DIGEST_UNKNOWN = "(unrecognised: "
DIGEST_BODY = "=== email body (stripped text) ==="

# Headings of the activity windows.
WINDOW_NONE = "—"
WINDOW_YESTERDAY = "Yesterday"
WINDOW_UP_TO = "Up to "
WINDOW_WEEK = "Last 7 days"
WINDOW_SINCE = "Since "
REPORT_HEADING = "RECENT ACTIVITY"

# Notices and totals of a cycle.
NOTICE_SAME_TITLE = " (same title + shared job id)"
NOTICE_REJECTED = "Rejected (no valid link): "
NOTICE_NO_UPDATE = "Status update — job not found in sheet (check spelling): "
NOTICE_NO_FLAG = "Flag — job not found in sheet: "
NOTICE_FAILED = "File FAILED (moved to outbox/failed/, nothing applied): "
NOTICE_NO_OBJECT = ("An outbox file must be a JSON object ({...}) with "
                    "upserts/updates/flags — got ")
CYCLE_HEADING = "## 🔧 Dispatch Summary\n"
CYCLE_RUN, CYCLE_RUNS, CYCLE_PROCESSED = "1 run", " runs", " processed · "
CYCLE_ADDED = " jobs added · "
CYCLE_SKIPPED = " skipped as duplicate · "
CYCLE_UPDATED = " cells updated · "
CYCLE_FLAGGED = " to approve\n"
CYCLE_WARNINGS = "\n## ⚠️ Dispatch warnings — needs a look\n"
SUBJECT_WARNINGS = "Job search digest — ⚠️ dispatch warnings "
